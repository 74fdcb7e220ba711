"""From raw documents to packed sequences: rules, deduplication, mixing and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from millrace.llm.text import table
from millrace.storage import staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or come from a rejected host go.

    Null, empty and short texts fail; documents without a source are one host.
    Repeated rows are judged alike. Texts count whole; further columns, whatever
    their names, pass through this stage and the next three.
    """
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays.

    Null texts equal empty ones; a null id ranks below all others. Of rows that
    repeat id and text one stays.
    """
    return exact_dedup.keep_largest(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words are in no group and stay. A null id ranks behind all
    others; of rows that repeat id and text one stays.
    """
    return ngram_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two times.

    Null sources are a source of their own; texts without words have size 0 and
    come once for each whole copy of their source. Rows equal in id and text
    share a decision.
    """
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens; the copies of a document are pieces of their own.

    Null and empty texts are one end token; longer documents are cut, none is
    dropped. Pieces of equal length are interchangeable. Further columns end
    here. An empty table gives no rows.
    """
    import public_tokenizers

    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixture), ("packing", packed)]

#: SQL has no byte-pair encoding and no seeded pivotal rounding; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
