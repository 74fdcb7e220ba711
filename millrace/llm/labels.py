"""Labelled rows for training, outside the held-out fold: all, or a bounded, deterministic sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import fold_of

#: Labelled rows a model is fitted on, at most, for each class.
PER_CLASS = 6000


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of every labelled row outside the held-out fold (crc32 of the id, modulo 5, is not 0).

    Null ids and labels are left out; repeated ids take the larger label.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold_of(F.col("doc_id")) != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(column).cast("int")).alias("label"))
    )


def training_labels(labels: DataFrame, column: str, per_class: int = PER_CLASS, seed: int = 0) -> DataFrame:
    """(doc_id, label) of at most ``per_class`` rows of each class, the first by a seeded hash of the id.

    Null ids and labels are left out; repeated ids take the larger label; the
    held-out fold (crc32 of the id, modulo 5, is 0) gives none. The result has
    at most ``2 * per_class`` rows of 12 bytes at any size of the table.
    """
    known = known_labels(labels, column)
    order = F.xxhash64("doc_id", F.lit(seed))
    return known.where("label = 1").orderBy(order, "doc_id").limit(per_class).unionByName(
        known.where("label = 0").orderBy(order, "doc_id").limit(per_class)
    )


def taught_rows(docs: DataFrame, chosen: DataFrame, *columns: str, bounded: bool = True) -> DataFrame:
    """``columns`` and ``label`` of one row of ``docs`` for each chosen id, so that no more rows than ids come out.

    Of rows that repeat an id, the one with the least hash of its columns is
    taken. ``chosen`` is broadcast if ``bounded`` (see :func:`training_labels`).
    """
    chosen = F.broadcast(chosen) if bounded else chosen
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns).join(chosen, "doc_id")
    one = found.groupBy("doc_id").agg(F.min_by(F.struct(*columns, "label"), F.xxhash64(*columns)).alias("r"))
    return one.select("r.*")
