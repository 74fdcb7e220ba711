"""Relational kernel: what plain SQL needs a helper for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.storage import staged


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def capped_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows per key; the rank filter is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap)


def anti_append(new: DataFrame, existing: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows to append: the first of each key in the batch, without keys that exist."""
    return first_per_key(new, keys, order).join(existing.select(*keys).distinct(), list(keys), "left_anti")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """``column NOT IN (SELECT other ...)`` with SQL's nulls: a null on the right rules out every row.

    Only two numbers of the right side reach the driver. An empty right side
    keeps all rows; else a null on the left is never kept.
    """
    n, nulls = right.agg(F.count(F.lit(1)), F.count_if(F.col(other).isNull())).first()
    if nulls:
        return left.where(F.lit(False))
    keys = right.select(F.col(other).alias("_other")).distinct()
    kept = left.join(keys, left[column] == keys["_other"], "left_anti")
    return kept.where(F.col(column).isNotNull()) if n else kept


def latest_rule(facts: DataFrame, rules: DataFrame, ladder: Sequence[str], kind: str = "kind") -> DataFrame:
    """:func:`ladder_matches` with a last step that fits all: rules of the rank ``universal``."""
    every = facts.withColumn("universal", F.lit("*"))
    return ladder_matches(every, rules, [*ladder, "universal"], kind).drop("universal")


def currently_valid(on: Column, valid_from: Column, valid_until: Column) -> Column:
    """Whether ``on`` lies in the closed interval; an open end lasts."""
    return (valid_from <= on) & (valid_until.isNull() | (on <= valid_until))


def staleness_days(on: Column, checked: Column, unknown: int = 10_000) -> Column:
    """Days since a date given as text; ``unknown`` where it cannot be read."""
    return F.coalesce(F.datediff(on, F.try_to_date(checked, "yyyy-MM-dd")), F.lit(unknown))


def replace_by_key(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-or-replace: rows of ``new``, and those of ``old`` whose key it lacks."""
    return new.unionByName(old.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def evidence_bar(df: DataFrame, keys: Sequence[str], group: str, rows: int = 40, groups: int = 25) -> DataFrame:
    support = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_images"), F.countDistinct(group).alias("n_groups"))
    return support.where((F.col("n_images") >= rows) & (F.col("n_groups") >= groups))


def dense_ids(names: DataFrame, name: str, start: int = 0, out: str = "class_id") -> DataFrame:
    """Ids without gaps in order of the (distinct) names, nulls last.

    Names go to range partitions, are numbered within each, and each partition
    begins where those before it end: no task holds more than a range.
    """
    ranged = names.select(name).distinct().repartitionByRange(F.col(name).asc_nulls_last())
    ranged = staged(ranged.withColumn("_p", F.spark_partition_id()), "dense-ids")
    counts = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_before")
    own = F.row_number().over(Window.partitionBy("_p").orderBy(F.col(name).asc_nulls_last()))
    ids = ranged.withColumn("_k", own).join(F.broadcast(before), "_p").select(name, (F.col("_before") + F.col("_k") - 1 + start).alias(out))
    ids._staged_at = ranged._staged_at  # may be released like a staged table
    return ids


def mint_ids(registry: DataFrame, names: DataFrame, name: str = "name", first: int = 1000) -> DataFrame:
    """Registry rows to append for unseen names: ids go on from the largest, in name order."""
    top = registry.agg(F.max("id")).first()[0]
    fresh = names.select(name).where(F.col(name).isNotNull()).distinct().join(registry.select(name), name, "left_anti")
    return dense_ids(fresh, name, first if top is None else top + 1, "id").select("id", name)


def resolve_merged(registry: DataFrame, most: int = 64) -> DataFrame:
    """(id, resolved): where chains of ``merged_into`` end; cycles raise."""
    at = registry.select("id", F.coalesce("merged_into", "id").alias("resolved"))
    step = at.select(F.col("id").alias("_i"), F.col("resolved").alias("_to"))
    for _ in range(most.bit_length()):
        at = at.join(step, at["resolved"] == step["_i"], "left").select("id", F.coalesce("_to", "resolved").alias("resolved"))
        step = at.select(F.col("id").alias("_i"), F.col("resolved").alias("_to"))
    moving = at.join(registry.where("merged_into is not null").select(F.col("id").alias("_m")), F.col("resolved") == F.col("_m"))
    if moving.limit(1).count():
        raise ValueError("a chain of merged ids does not end")
    return at


def count_distinct_over(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Distinct values per key beside every row, which windows do not offer."""
    counts = df.groupBy(*keys).agg(F.countDistinct(column).alias(out))
    return df.join(counts, list(keys))


def in_subtree(path: Column, root: Column | str) -> Column:
    """Whether the path of ancestors (joined by /) holds the root anywhere."""
    return F.array_contains(F.split(path, "/"), root)


def in_boxes(lat: Column, lon: Column, boxes: Sequence[tuple[float, float, float, float]]) -> Column:
    """Whether a point lies in one of the boxes (south, west, north, east)."""
    out = F.lit(False)
    for south, west, north, east in boxes:
        out = out | (lat.between(south, north) & lon.between(west, east))
    return F.coalesce(out, F.lit(False))


def search(names: DataFrame, query: str, columns: Sequence[str], least: int = 2) -> DataFrame:
    """Rows with a column that begins with (rank 0) or contains (rank 1) the query, any case."""
    q = query.strip().lower()
    if len(q) < least:
        return names.where(F.lit(False)).withColumn("match_rank", F.lit(0))
    lows = [F.lower(c) for c in columns]
    starts, holds = F.lit(False), F.lit(False)
    for c in lows:
        starts, holds = starts | F.coalesce(c.startswith(q), F.lit(False)), holds | F.coalesce(c.contains(q), F.lit(False))
    return names.where(holds).withColumn("match_rank", F.when(starts, 0).otherwise(1))


def ladder_matches(facts: DataFrame, rules: DataFrame, ladder: Sequence[str], kind: str = "kind") -> DataFrame:
    """Rules (rank, value, kind) on rows by the most specific rank of the ladder that has one."""
    steps = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(r).alias("rank"), F.col(r).cast("string").alias("value")) for i, r in enumerate(ladder)])
    long = facts.withColumn("_s", F.explode(steps)).select(*facts.columns, "_s.*")
    hit = long.join(rules, ["rank", "value"])
    return first_per_key(hit, [facts.columns[0], kind], [F.col("o")]).drop("o")


def require_none(df: DataFrame, what: str) -> None:
    """Raises with the number of offending rows, if there are any."""
    n = df.count()
    if n:
        raise ValueError(f"{what}: {n} rows")
