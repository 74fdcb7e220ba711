"""Scans with pinned schemas. Types are never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tsv(spark: SparkSession, path: str, schema: StructType, *, header: bool = True, null: str | None = None, parts: int | None = None) -> DataFrame:
    """Tab-separated text without quoting; a malformed line is an error.

    A gzip file is one partition whatever its size, so ``parts`` deals its rows out.
    """
    reader = spark.read.schema(schema).option("sep", "\t").option("header", header).option("quote", "").option("mode", "FAILFAST")
    if null is not None:
        reader = reader.option("nullValue", null)
    df = reader.csv(path)
    return df.repartition(parts) if parts else df


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exploded(spark: SparkSession, path: str, schema: StructType, array: str) -> DataFrame:
    """Items of paged JSON responses, one row each."""
    return json_documents(spark, path, schema).select(F.explode(array).alias("item")).select("item.*")


def files(spark: SparkSession, root: str, *, content: bool = False) -> DataFrame:
    """Content-addressed files: path, length, and the digest that the name states."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    named = df.withColumn("sha", F.regexp_extract("path", r"([0-9a-f]{64})\.[A-Za-z0-9]+$", 1))
    kept = [*(["content"] if content else [])]
    return named.select("path", "length", "sha", *kept)


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    return spark.read.text(path).limit(n)
