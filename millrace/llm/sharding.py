"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, permute each, write."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.storage import staged

SHARDS = 40
#: Bytes of text that a bucket is planned for, and beyond which it is scattered once more on disk.
BUCKET_BYTES = 16 << 20
SPLIT_BYTES = 64 << 20


def shard_columns(key: Column, n_shards: int, seed: int) -> Column:
    """Struct of ``shard`` and ``grown_shard`` by jumping consistent hashing.

    From shard b the next jump goes to floor((b + 1) / u) with u drawn from
    (key, b); the last place below the count is the shard. One more shard
    takes those rows whose next jump lands on it exactly, and no other moves.
    """

    def jump(b: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed), b), 11).cast("double") + 1.0) / F.lit(float(1 << 53))
        return F.least(F.floor((b + 1) / u), F.lit(1 << 40)).cast("long")

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("b"), jump(zero).alias("j"))
    # b grows with each jump: n_shards rounds always suffice, and beyond 128 none are left in practice
    rounds = F.sequence(F.lit(1), F.lit(min(n_shards, 128)))
    end = F.aggregate(
        rounds,
        start,
        lambda s, _: F.when(s["j"] < n_shards, F.struct(s["j"].alias("b"), jump(s["j"]).alias("j"))).otherwise(s),
        lambda s: F.struct(
            s["b"].cast("int").alias("shard"),
            F.when(s["j"] == n_shards, F.lit(n_shards)).otherwise(s["b"]).cast("int").alias("grown_shard"),
        ),
    )
    return end


def _permuted(batches: list[pa.RecordBatch], rng: np.random.Generator) -> pa.Table:
    """Rows in the order of a Fisher-Yates shuffle (numpy's permutation)."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    return rows.take(pa.array(rng.permutation(len(rows))))


def _bucket(
    batches: Iterator[pa.RecordBatch], rng: np.random.Generator, split_bytes: int
) -> Iterator[pa.Table]:
    """A bucket's rows in uniformly random order.

    A bucket beyond ``split_bytes`` is scattered over files in the task's own
    temporary folder, each row to a random one, and each file is shuffled in
    turn: the same two passes, so the order stays uniform and memory bounded.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size > split_bytes:
            break
    else:
        if held:
            yield _permuted(held, rng)
        return
    schema, ways = held[0].schema, 8
    with tempfile.TemporaryDirectory() as folder:
        paths = [os.path.join(folder, str(k)) for k in range(ways)]
        sinks = [pa.OSFile(p, "wb") for p in paths]
        outs = [pa.ipc.new_stream(s, schema) for s in sinks]
        while held:
            b = held.pop(0)
            to = rng.integers(0, ways, len(b))
            for k in range(ways):
                if (to == k).any():
                    outs[k].write_batch(b.filter(pa.array(to == k)))
            if not held and (nxt := next(batches, None)) is not None:
                held.append(nxt)
        for o, s in zip(outs, sinks):
            o.close()
            s.close()
        for p in paths:
            with pa.OSFile(p, "rb") as src:
                yield from _bucket(iter(pa.ipc.open_stream(src)), rng, split_bytes)
            os.remove(p)


def _shuffler(seed: int, split_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def refill() -> bool:
            while not pending:
                b = next(batches, None)
                if b is None:
                    return False
                if len(b):
                    pending.append(b)
            return True

        def one(bucket: int) -> Iterator[pa.RecordBatch]:
            while refill():
                b = pending.pop(0)
                ids = b.column("_bucket").to_numpy(zero_copy_only=False)
                n = int(np.searchsorted(ids, bucket, side="right"))
                if n < len(b):
                    pending.insert(0, b.slice(n))
                if n:
                    yield b.slice(0, n)
                if n < len(b):
                    return

        while refill():
            bucket = pending[0].column("_bucket")[0].as_py()
            rng, at = np.random.default_rng([seed, bucket]), 0
            for t in _bucket(one(bucket), rng, split_bytes):
                for b in t.to_batches(max_chunksize=2000):
                    pos = pa.array(np.arange(at, at + len(b), dtype=np.int64))
                    at += len(b)
                    yield pa.RecordBatch.from_arrays([*b.columns, pos], names=[*b.schema.names, "_pos"])

    return run


def external_shuffle(
    docs: DataFrame,
    n_shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 0,
    bucket_bytes: int = BUCKET_BYTES,
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """All columns of ``docs`` plus ``shard``, ``grown_shard``, ``_bucket`` and ``_pos``, in shuffled order.

    Pass one scatters the rows by seeded hashes: the id decides the shard, id
    and text the bucket within it, with as many buckets as planned bytes need.
    Pass two holds one bucket at a time and permutes it. Rows are first sorted
    by bucket, id and text hash, so the order is a function of the rows and
    the seed; rows equal in both are interchangeable. Null ids share a shard
    and are spread over its buckets by their texts; null, empty and very long
    texts, empty tables and further columns pass through. Columns of ``docs``
    with the names of the four added ones are replaced by them.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    per_shard = max(1, -(-total // (n_shards * bucket_bytes)))
    n_buckets = n_shards * per_shard
    key = F.col(id_col)
    spread = F.xxhash64(key, F.col(text_col), F.lit(seed + 1))
    # whole rows travel in one column, so no name among theirs can clash
    where = docs.select(F.struct(*docs.columns).alias("_row"), shard_columns(key, n_shards, seed).alias("_s"), spread.alias("_h"), key.alias("_key"))
    bucket = F.col("_s.shard").cast("long") * per_shard + F.pmod(F.col("_h"), F.lit(per_shard))
    flat = where.select("_row", F.col("_s.shard").alias("shard"), F.col("_s.grown_shard").alias("grown_shard"), "_h", "_key", bucket.cast("long").alias("_bucket"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = flat.repartition(max(1, min(n_buckets, max(least, total // (2 * bucket_bytes)))), "_bucket")
    ordered = dealt.sortWithinPartitions("_bucket", "_h", "_key")
    schema = T.StructType([*ordered.schema.fields, T.StructField("_pos", T.LongType())])
    placed = ordered.mapInArrow(_shuffler(seed, split_bytes), schema)
    added = ["shard", "grown_shard", "_bucket", "_pos"]
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns if c not in added], *added)


def with_slots(shuffled: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, shard, grown_shard and ``slot``, the gapless place within the shard.

    A slot is the place in the bucket after all rows of the shard's earlier
    buckets; only one count per bucket is needed for that.
    """
    held = staged(shuffled.select(*keep, "shard", "grown_shard", "_bucket", "_pos"), "shard-places")
    before = held.groupBy("shard", "_bucket").count()
    before = before.select(
        F.col("_bucket").alias("_b"),
        (F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("count")).alias("_before"),
    )
    return held.join(before, held["_bucket"] == before["_b"]).select(
        *keep, "shard", "grown_shard", (F.col("_before") + F.col("_pos")).alias("slot")
    )


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write the shuffled rows as Parquet, one folder per shard, in their shuffled order."""
    shuffled.drop("grown_shard").write.partitionBy("shard").parquet(path)
