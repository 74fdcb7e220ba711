"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.text import unit, words
from millrace.storage import staged

#: Weights that repeat over the sources in code-point order.
WEIGHTS = (5, 2, 1)
#: Units that one fold takes; a level of the reduction tree shrinks the rows by this factor.
FAN_IN = 128


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Per row: id, source, size in words, and a hash of the text that tells equal ids apart."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
        F.xxhash64(F.col(text_col)).alias("_xx"),
    )


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """One row per source: ``source_size``, documents, weight and ``target``.

    The budget (``share`` of all sizes) is dealt by weight; targets stop at
    ``limit`` times the source's size and the excess is dealt again by weight
    to the others until none is above. Each round sends two sums to the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = staged(with_rank(per), "mix-sources")
    ladder = F.array(*[F.lit(float(w)) for w in weights])
    per = ranked.withColumn("weight", F.get(ladder, (F.col("_rank") % len(weights)).cast("int"))).withColumn(
        "_cap", F.col("source_size") * F.lit(float(limit))
    )
    row = per.agg(F.sum("source_size").alias("all"), F.sum("weight").alias("w")).first()
    if not row["all"]:
        return per.withColumn("target", F.lit(0.0))
    budget = share * row["all"]
    level, free = budget / row["w"], row["w"]
    while True:
        capped = F.col("weight") * F.lit(level) > F.col("_cap")
        got = per.where(capped).agg(F.sum("_cap").alias("c"), F.sum("weight").alias("w")).first()
        left = row["w"] - (got["w"] or 0.0)
        if left >= free or left <= 0:
            break
        level, free = (budget - got["c"]) / left, left
    return per.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("_cap")))


def with_rank(per: DataFrame) -> DataFrame:
    """``_rank``: the place of each source by code point, null last, counted from 0.

    Range partitions are numbered within themselves and offset by the sizes of
    those before, so no task sees all sources however many there are.
    """
    order = F.col("source").asc_nulls_last()
    parts = int(per.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = staged(per.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()), "mix-ranges")
    within = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(order)))
    before = (
        cut.groupBy("_part")
        .count()
        .withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
        .select("_part", "_before")
    )
    return within.join(before, "_part").select(
        *per.columns, (F.col("_before") + F.col("_at") - 1).alias("_rank")
    )


def _pivot(a: Column, b: Column, draw: Column) -> Column:
    """Transfer mass between two units until one is integral; size-weighted mass is conserved.

    With the chances that keep every expectation, either ``a`` rises and ``b``
    falls or the other way round, as far as the first bound allows.
    """
    sa, sb = a["size"].cast("double"), b["size"].cast("double")
    up = F.least((1 - a["x"]) * sa, b["x"] * sb)
    down = F.least(a["x"] * sa, (1 - b["x"]) * sb)
    rise = draw * (up + down) < down

    def outcome(done: Column, value: int, rest: Column, x: Column) -> Column:
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
        return F.struct(
            F.struct(done["id"].alias("id"), F.lit(value).alias("one")).alias("done"),
            F.struct(rest["id"].alias("id"), rest["size"].alias("size"), x.alias("x")).alias("rest"),
        )

    rising = F.when((1 - a["x"]) * sa <= b["x"] * sb, outcome(a, 1, b, b["x"] - up / sb)).otherwise(
        outcome(b, 0, a, a["x"] + up / sa)
    )
    falling = F.when(a["x"] * sa <= (1 - b["x"]) * sb, outcome(a, 0, b, b["x"] + down / sb)).otherwise(
        outcome(b, 1, a, a["x"] - down / sa)
    )
    return F.when(rise, rising).otherwise(falling)


def _fold(units: DataFrame, chunks: Column, seed: int, level: int) -> DataFrame:
    """One level of the tree: each chunk of units leaves one undecided unit and the others' outcomes."""
    chunk = F.pmod(F.xxhash64("id", F.lit(seed), F.lit(level)), chunks)
    grouped = (
        units.withColumn("_chunk", chunk)
        .groupBy("source", "_chunk", "n_units")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "id", "size", "x"))).alias("_u"))
        .withColumn("_u", F.transform("_u", lambda u: F.struct(u["id"].alias("id"), u["size"].alias("size"), u["x"].alias("x"))))
    )
    empty = F.expr("cast(array() as array<struct<id: struct<doc_id: bigint, xx: bigint>, one: int>>)")
    start = F.struct(empty.alias("done"), F.get("_u", F.lit(0)).alias("rest"))

    def step(acc: Column, u: Column) -> Column:
        got = _pivot(acc["rest"], u, unit(acc["rest"]["id"], u["id"], F.lit(seed), F.lit(level)))
        return F.transform(
            F.array(got), lambda g: F.struct(F.array_append(acc["done"], g["done"]).alias("done"), g["rest"].alias("rest"))
        )[0]

    return grouped.select(
        "source",
        "n_units",
        F.aggregate(F.slice("_u", F.lit(2), F.greatest(F.size("_u") - 1, F.lit(0))), start, step).alias("_r"),
    )


def pivotal_rounding(units: DataFrame, seed: int = 0, fan_in: int = FAN_IN) -> DataFrame:
    """Round the fractions ``x`` of units (source, id, size, x, n_units) to 0 or 1.

    ``n_units`` is a bound of the units in the source.

    Units are dealt to chunks of about ``fan_in`` by a hash of their id and
    folded; the undecided unit of each chunk goes on to the next level, until
    one is left per source, which is rounded to the nearest. The rounded sizes
    of a source differ from its mass by half a document at most. A source with
    a third of all rows is only more chunks. Returns source, id and one.
    """
    most = units.agg(F.max("n_units")).first()[0] or 0
    level_units = units
    decided: DataFrame | None = None
    level, width = 0, float(fan_in)
    while True:
        chunks = F.ceil(F.col("n_units") / F.lit(width)).cast("long")
        folded = staged(_fold(level_units, chunks, seed, level), f"mix-level{level}")
        out = folded.select("source", F.explode("_r.done").alias("d")).select("source", "d.id", "d.one")
        decided = out if decided is None else decided.unionByName(out)
        rest = folded.select("source", "_r.rest.id", "_r.rest.size", "_r.rest.x", "n_units")
        if most <= width:
            break
        level_units, width, level = rest, width * fan_in, level + 1
    last = rest.select("source", "id", F.when(F.col("x") >= 0.5, 1).otherwise(0).alias("one"))
    return decided.unionByName(last)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: float = 2.0,
    seed: int = 0,
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target and ``copies`` (0, 1 or 2).

    Every document of a source is worth target / source_size copies; the whole
    part is taken, the fraction decided by :func:`pivotal_rounding`. Rows
    without words have size 0 and one copy for each whole part; nulls form
    their own source, ordered last. Rows that repeat id and text are one unit and
    share its decision. Outcomes depend on ids, texts and the seed alone, so reruns on
    any partitioning agree.
    """
    sized = staged(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    aims = staged(targets(sized, weights, share, limit).select("source", "source_size", "n_docs", "target"), "mix-targets")
    worth = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sized.join(aims, sized["source"].eqNullSafe(aims["source"])).select(
        sized["doc_id"], sized["source"], "size", "_xx", "source_size", "n_docs", "target", worth.alias("_f")
    )
    rows = rows.withColumn("_whole", F.floor("_f").cast("int")).withColumn("_x", F.col("_f") - F.col("_whole"))
    units = (
        rows.where((F.col("size") > 0) & (F.col("_x") > 1e-12))
        .groupBy("source", F.struct("doc_id", F.col("_xx").alias("xx")).alias("id"))
        .agg(F.sum("size").alias("size"), F.first("_x").alias("x"), F.first("n_docs").alias("n_units"))
    )
    rounded = pivotal_rounding(units, seed).select(
        F.col("source").alias("_s"), F.col("id.doc_id").alias("_i"), F.col("id.xx").alias("_h"), "one"
    )
    return rows.join(
        rounded,
        rows["doc_id"].eqNullSafe(rounded["_i"]) & (rows["_xx"] == rounded["_h"]) & rows["source"].eqNullSafe(rounded["_s"]),
        "left",
    ).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "_xx",
        (F.col("_whole") + F.coalesce("one", F.lit(0))).alias("copies"),
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each as often as it has copies, with all columns."""
    taken = (
        mix(docs, id_col, text_col, source_col, **options)
        .where("copies > 0")
        .select(F.col("doc_id").alias("_i"), F.col("_xx").alias("_h"), F.col("source").alias("_s"), "copies")
        .distinct()
    )
    # whole rows travel in one column, so no name among theirs can clash
    rows = docs.select(
        F.struct(*docs.columns).alias("_row"),
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_text_hash"),
        F.col(source_col).alias("_from"),
    )
    match = rows["_id"].eqNullSafe(taken["_i"]) & (rows["_text_hash"] == taken["_h"]) & rows["_from"].eqNullSafe(taken["_s"])
    joined = rows.join(taken, match).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
    return joined.select("_row.*")
