"""Hamming similarity of 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import hamming


def hamming_pairs(df: DataFrame, id_col: str, hash_col: str, within: str | None = None, threshold: int = 6, copies: bool = False) -> DataFrame:
    """(a, b, distance) with a < b for all pairs of rows whose hashes differ in ``threshold`` bits at most.

    Exact: of threshold + 2 bands of the 64 bits such a pair agrees in two at
    least, so rows meet in pairs of bands (16 bits of eight bands at threshold
    6). Rows with equal hashes are joined through their smallest id, so that
    copies of one hash do not pair among each other in every band; each pair of
    hashes is found in its first two common bands alone. With ``copies`` every
    pair of rows is returned, those of copies too, as many as there are; rows of
    equal or null ids do not pair. With ``within`` only rows of the same class
    pair. Null hashes never pair.
    """
    keys = [within] if within else []
    one = df.where(F.col(hash_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(hash_col).alias("h"), *keys)
    reps = one.groupBy("h", *keys).agg(F.min("id").alias("rep"))
    n, cuts = threshold + 2, [64 * k // (threshold + 2) for k in range(threshold + 3)]
    band = lambda h, k: F.shiftrightunsigned(h, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
    both = lambda j, k: F.struct(F.lit(n * j + k).alias("k"), F.shiftleft(band(F.col("h"), j), 32).bitwiseOR(band(F.col("h"), k)).alias("v"))
    bands = F.array(*[both(j, k) for j in range(n) for k in range(j + 1, n)])
    cut = reps.withColumn("_b", F.explode(bands)).select("h", *keys, "rep", F.col("_b.k").alias("k"), F.col("_b.v").alias("v"))
    x, y = cut.alias("x"), cut.alias("y")
    same = (F.col("x.k") == F.col("y.k")) & (F.col("x.v") == F.col("y.v")) & (F.col("x.h") < F.col("y.h"))
    for c in keys:
        same = same & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    agree = F.array_compact(F.array(*[F.when(band(F.col("x.h"), k) == band(F.col("y.h"), k), k) for k in range(n)]))
    first = F.get(agree, F.lit(0)) * n + F.get(agree, F.lit(1))
    d = hamming(F.col("x.h"), F.col("y.h"))
    met = x.join(y, same & (d <= threshold) & (F.col("x.k") == first))
    classes = [F.col(f"x.{c}").alias(c) for c in keys]
    if copies:
        near = met.select(F.col("x.h").alias("h"), F.col("y.h").alias("hy"), *classes, d.cast("int").alias("distance"))
        rows = one.where(F.col("id").isNotNull())
        p, q = rows.withColumnRenamed("id", "p"), rows.withColumnRenamed("id", "q")
        apart = near.join(p, ["h", *keys]).drop("h").join(q.withColumnRenamed("h", "hy"), ["hy", *keys]).where("p <> q")
        equal = p.join(q, ["h", *keys]).where("p < q").withColumn("distance", F.lit(0))
        both = apart.select("p", "q", "distance").unionByName(equal.select("p", "q", "distance"))
        return both.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")
    near = met.where(F.col("x.rep") != F.col("y.rep")).select(
        F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), d.cast("int").alias("distance")
    )
    equal = one.join(reps, ["h", *keys]).where(F.col("id") != F.col("rep")).select(
        F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(0).alias("distance")
    )
    return near.unionByName(equal)
