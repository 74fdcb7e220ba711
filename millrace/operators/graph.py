"""Connected components over an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.storage import release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step over distinct edges (u, v) with u < v."""
    flipped = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    if large:
        both = edges.unionByName(flipped)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = flipped.groupBy("u").agg(F.min("v").alias("m"))
        joined = flipped.join(least, "u")
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v) except the roots; root is the least node.

    Alternates large-star and small-star steps, which end after about the
    logarithm of the longest path, and writes the edges to the shared folder
    after each, so a lost executor never replays earlier rounds. Only a count
    and a checksum per round reach the driver.
    """
    edges = staged(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "cc"
    )
    seen = None
    while True:
        before, edges = edges, staged(_star(_star(edges, True), False), "cc")
        release(before)
        # summed modulo a prime far below 2**63 / rows, so the sum cannot overflow
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003)))).first()
        if now == seen:
            out = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
            out._staged_at = edges._staged_at  # may be released like a staged table
            return out
        seen = now


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for all ``nodes``, lone ones included."""
    return nodes.join(components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def leak_edges(contents: DataFrame, *groupings: str, key: str = "sha") -> DataFrame:
    """Edges (u, v) from the first content of each group to its others, for every column of ``groupings``.

    A star gives the same components as all pairs and is linear in the group.
    Nulls group nothing.
    """
    out = None
    for g in groupings:
        rows = contents.where(F.col(g).isNotNull()).select(key, g).distinct()
        first = rows.groupBy(g).agg(F.min(key).alias("u"))
        star = rows.join(first, g).where(F.col(key) != F.col("u")).select("u", F.col(key).alias("v"))
        out = star if out is None else out.unionByName(star)
    return out.distinct()
