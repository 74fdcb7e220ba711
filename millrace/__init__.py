"""millrace: a PySpark-native engine for curating, auditing and serving media and text corpora."""

__version__ = "0.1.0"
