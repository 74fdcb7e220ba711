"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import ascii_lower
from millrace.storage import staged

SALTS = 256


def _keyed(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """Every row with its normalised text, two digests of it, and a salt.

    The salt is the input partition, so that all copies within a task carry
    the same one and the map-side aggregation merges them before any shuffle.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).alias("_id"), norm.alias("_text")).select(
        "_id",
        "_text",
        F.sha2("_text", 256).alias("_sha"),
        F.xxhash64("_text").alias("_xx"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_salt"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per text: its digests, largest id and number of rows.

    Three stages, each with the full text among the grouping keys, so equal
    digests of different texts never merge: within a task (map-side), within
    (text, salt), and over the salts' winners. A text that fills a third of
    all rows reaches the last stage as at most ``salts`` rows.
    """
    by = ["_sha", "_xx", "_text"]
    salted = (
        _keyed(docs, id_col, text_col, salts)
        .groupBy(*by, "_salt")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    return salted.groupBy(*by).agg(F.max("_keep").alias("_keep"), F.sum("_n").alias("_n"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """Per row: its id, the id that stays of its group, group size and digest.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty, and all empty texts form one group. The largest id stays; rows that
    repeat an id (with the same text) are told apart nowhere: each counts in
    ``group_size`` and each row with the largest id is marked kept. A null id
    ranks below every other. Further columns are ignored, whatever their names.

    Rows find their group by both digests (320 bits) and not by text, which
    would shuffle the corpus once more; should two different texts ever share
    both, the query fails rather than mix them.
    """
    groups = (
        exact_groups(docs, id_col, text_col, salts)
        .groupBy("_sha", "_xx")
        .agg(F.max("_keep").alias("_keep"), F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_texts"))
        .select(
            "_sha",
            "_xx",
            "_keep",
            F.when(F.col("_texts") == 1, F.col("_n"))
            .otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long"))
            .alias("_n"),
        )
    )
    rows = _keyed(docs, id_col, text_col, salts).select("_id", "_sha", "_xx")
    return rows.join(groups, ["_sha", "_xx"]).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_n").cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def keep_largest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of each group of equal texts, that of the largest id, with all its columns.

    Rows are matched by id and digest, so a repeated id with another text is
    judged on its own. Of rows that repeat both, the one with the least hash
    of the whole row stays; where all else is equal, any one of them.
    """
    norm = ascii_lower(F.coalesce(docs[text_col], F.lit("")))
    # whole rows travel in one column, so no name among theirs can clash
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.sha2(norm, 256).alias("_sha"))
    groups = (
        exact_dedup(docs, id_col, text_col, salts)
        .where("kept")
        .groupBy(F.col("doc_id").alias("_kid"), F.col("text_sha256").alias("_ksha"))
        .agg(F.count(F.lit(1)).alias("_times"))
    )
    groups = staged(groups, "dedup-kept")
    same = F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_sha") == F.col("_ksha"))
    once = held.join(groups.where("_times = 1"), same, "left_semi").select("_row")
    twice = groups.where("_times > 1")
    if not twice.isEmpty():
        plain = [F.col("_row").getField(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        again = held.join(twice, same, "left_semi").groupBy("_id", "_sha").agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row"))
        once = once.unionByName(again.select("_row"))
    return once.select("_row.*")
