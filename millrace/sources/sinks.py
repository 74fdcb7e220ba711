"""Writers: sorted exports, idempotent appends, replacement by key and by partition."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession

from millrace.operators.relational import anti_append
from millrace.sources.tables import Files


def sorted_parquet(df: DataFrame, path: str, order: list[Column | str], mode: str = "error") -> None:
    """Globally sorted zstd Parquet; range partitions keep the sort parallel."""
    df.orderBy(*order).write.mode(mode).option("compression", "zstd").parquet(path)


def csv(df: DataFrame, path: str, order: list[Column | str]) -> None:
    df.orderBy(*order).write.option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(df: DataFrame, path: str, keys: list[str], order: list[Column]) -> None:
    """Appends the rows whose key the table lacks, one per key; repeating a batch changes nothing."""
    spark = df.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else df.limit(0)
    anti_append(df, old, keys, order).write.mode("append").parquet(path)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that occur in ``df``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def open_and_sealed(df: DataFrame, sealed: Column, open_path: str, sealed_path: str) -> None:
    """Two exports; rows of the sealed one are never in the other."""
    df.where(~sealed).write.parquet(open_path)
    df.where(sealed).write.parquet(sealed_path)


def report(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as a JSON document; written aside and renamed."""
    got = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError("a report is a small result")
    Files(rows.sparkSession, path).write(path, json.dumps(got, default=str, indent=1), replace=True)
