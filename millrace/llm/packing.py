"""Best-fit packing with exact-complement hashing over a histogram of lengths."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.storage import staged

CAPACITY = 1024
END = 2
#: Chunks of text whose ids a worker remembers.
CACHE = 120_000
_encoders: dict[str, "_Encoder"] = {}


class _Encoder(dict):
    """Ids (uint32, little-endian bytes) of chunks that begin with one space.

    A single space between two other characters always begins a new
    pre-token, so a text that has only such spaces is the join of its chunks;
    equal chunks are encoded once. ``tokenizers`` defines the ids; a chunk of
    plain Latin text goes through ``tiktoken`` with the same ranks, which the
    tests hold against it, for it is five times as fast.
    """

    def __init__(self, path: str) -> None:
        import tiktoken

        self.path, self._exact = path, None
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @property
    def exact(self):
        if self._exact is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self._exact = Tokenizer.from_file(self.path)
        return self._exact

    def encode(self, text: str) -> bytes:
        if text.isascii() or max(text) < "ɐ":
            if "<|" not in text:
                return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Apart
        if len(self) >= CACHE:
            self.clear()
        got = self.encode(" " + chunk)
        if len(chunk) <= 40:
            self[chunk] = got
        return got

    def ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.encode(text)
        try:
            return b"".join([self.encode(first), *[self[c] for c in rest]])
        except _Apart:
            return self.encode(text)


class _Apart(Exception):
    """A space has white space beside it: the text is encoded as a whole."""


def _encoder(path: str) -> _Encoder:
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones, and the remainder, if any, first."""
    head = n % capacity if n > capacity else n
    edges = [0, *range(head, n + 1, capacity)] if head else list(range(0, n + 1, capacity))
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def tokenized_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """Per piece: doc_id, piece, start, length and ``ids`` (uint32, little-endian).

    Each text's ids are followed by ``end``; null and empty texts have it
    alone. Documents longer than ``capacity`` are cut, the remainder first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = _encoder(tokenizer), np.array([end], dtype="<u4").tobytes()
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.slice(lo, 200)
                out: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = (enc.ids(text) if text else b"") + tail
                    for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                        out.append((doc, k, a, n, ids[4 * a : 4 * (a + n)]))
                cols = list(zip(*out)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "piece", "start", "length", "ids"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary"
    )


def sum_index(lengths: np.ndarray, many: int, most: int) -> dict[int, np.ndarray]:
    """Sums up to ``most`` of ``many`` of the lengths (each usable again), to the combinations, largest members first."""
    n = np.sort(lengths)[::-1]
    at = np.arange(len(n))[:, None]
    for _ in range(many - 1):
        more = np.repeat(at, len(n), axis=0), np.tile(np.arange(len(n)), len(at))
        ok = more[1] >= more[0][:, -1]
        at = np.column_stack([more[0][ok], more[1][ok]])
    rows = n[at]
    total = rows.sum(axis=1)
    rows, total = rows[total <= most], total[total <= most]
    order = np.argsort(total, kind="stable")
    rows, total = rows[order], total[order]
    edge = np.flatnonzero(np.r_[True, total[1:] != total[:-1]]) if len(total) else np.zeros(0, int)
    return {int(total[x]): rows[x:y] for x, y in zip(edge, np.r_[edge[1:], len(total)])}


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with the number of sequences each fills.

    Works on the histogram alone (at most ``capacity`` lengths), so its cost
    does not depend on the number of pieces. (1) A length meets its exact
    complement, as often as both last. (2) Other lengths above ``capacity //
    8`` open sequences, longest first, or go best-fit into an open one. (3) The
    gaps are looked up, smallest first, in indexes of the single, pair and
    triple sums of the lengths that are left: a combination that fills a gap
    exactly is consumed as often as gaps and counts last. Counts only shrink,
    so a combination that is used up is never looked at again. (4) What is
    left goes best-fit, longest first.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] += c
    done: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        done.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    for a in range(capacity - 1, (capacity - 1) // 2, -1):
        b = capacity - a
        m = int(left[a] // 2 if a == b else min(left[a], left[b]))
        if m:
            done.append(((a, b), m))
            left[a] -= m
            left[b] -= m
    open_: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]  # (pattern, number) by gap

    def best_fit(longest: int, least: int) -> None:
        for a in range(longest, least - 1, -1):
            while left[a]:
                g = next((g for g in range(a, capacity) if open_[g]), None)
                if g is None:
                    many, more = divmod(int(left[a]), capacity // a)
                    for times, m in ((capacity // a, many), (more, 1)):
                        if times and m:
                            open_[capacity - times * a].append(((a,) * times, m))
                    left[a] = 0
                    continue
                pattern, m = open_[g].pop()
                used = int(min(m, left[a]))
                if m > used:
                    open_[g].append((pattern, m - used))
                open_[g - a].append(((*pattern, a), used))
                left[a] -= used

    short = capacity // 8
    best_fit(capacity - 1, short + 1)
    lengths = np.flatnonzero(left[: short + 1])
    for many in (1, 2, 3):
        index = sum_index(lengths, many, capacity - 1)
        for g in range(1, capacity):
            for rows in index.get(g, ()) if open_[g] else ():
                need = np.bincount(rows, minlength=capacity + 1)
                at = np.flatnonzero(need)
                while open_[g] and (m := int((left[at] // need[at]).min())) > 0:
                    pattern, held = open_[g].pop()
                    used = min(m, held)
                    if held > used:
                        open_[g].append((pattern, held - used))
                    done.append(((*pattern, *rows.tolist()), used))
                    left[at] -= used * need[at]
                if not open_[g]:
                    break
    best_fit(short, 1)
    return done + [(pattern, m) for group in open_ for pattern, m in group]


def _ranges(plan: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: where its ranges of ranks begin, the first sequence of each, and the offset."""
    rows: dict[int, list[tuple[int, int, int]]] = {}
    seen, seq = [0] * (capacity + 1), 0
    for pattern, m in plan:
        at = 0
        for n in pattern:
            rows.setdefault(n, []).append((seen[n], seq, at))
            seen[n] += m
            at += n
        seq += m
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, with ``length``) plus ``sequence_id`` and ``offset``.

    Lengths run from 1 to ``capacity``. The plan is made from the histogram of
    lengths; then the k-th piece of a length takes the k-th place the plan has
    for it. Pieces are ranked within (length, partition) and offset by the
    counts of earlier partitions, so a length that a third of all pieces share
    is never gathered in one task.
    """
    held = pieces.withColumn("_part", F.spark_partition_id())
    held = staged(held, "pack-pieces")
    counts = held.groupBy("length", "_part").count()
    counts = staged(
        counts.withColumn(
            "_before", F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")
        ),
        "pack-counts",
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    ranges = _ranges(plan_packing(histogram, capacity), capacity)
    names = list(pieces.columns)
    order = Window.partitionBy("length", "_part").orderBy(F.xxhash64(*pieces.columns))
    ranked = held.withColumn("_at", F.row_number().over(order)).join(
        counts.select("length", "_part", "_before"), ["length", "_part"]
    )
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_at") - 1).alias("_rank"))
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                begin, first, offset = ranges[int(length)]
                k = np.searchsorted(begin, rank[at], side="right") - 1
                seq[at], off[at] = first[k] + rank[at] - begin[k], offset[k]
            kept = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
