"""Metrics of predictions: confusion, calibration, coverage, fallback and open sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 15


def confusion(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """Wrong pairs with count and share of the true class."""
    support = pred.groupBy(truth).agg(F.count(F.lit(1)).alias("support"))
    pairs = pred.where(F.col(truth) != F.col(guess)).groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(support, truth).select(truth, guess, "n", (F.col("n") / F.col("support")).alias("rate"))


def per_class(pred: DataFrame, truth: str = "label", guess: str = "pred") -> DataFrame:
    """Support, precision, recall and F1 of every class that is true or predicted; one shuffle of counts."""
    sides = pred.select(
        F.explode(
            F.array(
                F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(guess)).cast("int").alias("h")),
                F.struct(F.col(guess).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")),
            )
        ).alias("s")
    )
    n = sides.groupBy(F.col("s.c").alias("class")).agg(
        F.sum("s.t").alias("support"), F.sum("s.p").alias("predicted"), F.sum("s.h").alias("hits")
    )
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    n = n.withColumn("precision", safe(F.col("hits"), F.col("predicted"))).withColumn("recall", safe(F.col("hits"), F.col("support")))
    return n.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def calibration_error(pred: DataFrame, conf: str = "conf", correct: str = "correct", bins: int = BINS) -> DataFrame:
    b = F.least((F.col(conf) * bins).cast("int"), F.lit(bins - 1))
    per = pred.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(conf).alias("c"), F.avg(F.col(correct).cast("double")).alias("a")
    )
    return per.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def coverage_curve(pred: DataFrame, thresholds: Sequence[float], conf: str = "conf", correct: str = "correct") -> DataFrame:
    """Share answered and accuracy of the answers per threshold.

    Thresholds are counted by one aggregation over the rows, not by a join.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(thresholds):
        aggs += [
            F.count_if(F.col(conf) >= t).alias(f"k{i}"),
            F.count_if((F.col(conf) >= t) & F.col(correct)).alias(f"h{i}"),
        ]
    one = pred.agg(*aggs)
    rows = F.array(
        *[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("k"), F.col(f"h{i}").alias("h")) for i, t in enumerate(thresholds)]
    )
    long = one.select("n", F.explode(rows).alias("r")).select("n", "r.*")
    return long.select(
        "threshold",
        (F.col("k") / F.col("n")).alias("coverage"),
        F.when(F.col("k") > 0, F.col("h") / F.col("k")).alias("accuracy"),
    )


def choose_threshold(curve: DataFrame, accuracy: float = 0.9, coverage: float = 0.2, default: float = 0.35) -> DataFrame:
    ok = curve.where((F.col("accuracy") >= accuracy) & (F.col("coverage") > coverage))
    return ok.agg(F.coalesce(F.min("threshold"), F.lit(default)).alias("threshold"))


def group_mass(probs: DataFrame, classes: DataFrame, id_col: str, group: str = "genus") -> DataFrame:
    """Per row and group the sum of its classes' probabilities; ``probs``: id, class, p."""
    return probs.join(classes, "class").groupBy(id_col, group).agg(F.sum("p").alias("mass"))


def temperature(pred: DataFrame, logits: str = "logits", label: str = "label", lo: float = 0.05, hi: float = 10.0, points: int = 16, rounds: int = 7) -> float:
    """The temperature of least negative log-likelihood, by a grid that narrows; one job a round."""
    def loss(t: float) -> Column:
        z = F.transform(logits, lambda v: v.cast("double") / F.lit(t))
        top = F.array_max(z)
        total = F.aggregate(F.transform(z, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v)
        return F.avg(F.log(total) + top - F.get(z, F.col(label)))

    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        aggs = [loss(t).alias(f"t{i}") for i, t in enumerate(grid)]
        row = pred.agg(*aggs).first()
        best = min(range(points), key=lambda i: (row[i], i))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    return (lo + hi) / 2


def similar_classes(conf: DataFrame, dangerous: DataFrame, count: int = 2, rate: float = 0.02) -> DataFrame:
    """Confusions in both directions, with a lower bar where exactly one side is dangerous."""
    d = dangerous.select(F.col("class").alias("_d"), F.lit(True).alias("_is"))
    x = conf.join(d, conf["label"] == F.col("_d"), "left").withColumn("d1", F.coalesce("_is", F.lit(False))).drop("_d", "_is")
    x = x.join(d, F.col("pred") == F.col("_d"), "left").withColumn("d2", F.coalesce("_is", F.lit(False))).drop("_d", "_is")
    crossing = F.col("d1") != F.col("d2")
    kept = x.where(((F.col("n") >= count) & (F.col("rate") >= rate)) | (crossing & (F.col("n") >= 1)))
    both = F.explode(
        F.array(F.struct(F.col("label").alias("a"), F.col("pred").alias("b")), F.struct(F.col("pred").alias("a"), F.col("label").alias("b")))
    )
    return kept.select(both.alias("p"), "rate", crossing.alias("safety")).groupBy("p.a", "p.b").agg(
        F.max("rate").alias("rate"), F.max("safety").alias("safety")
    )
