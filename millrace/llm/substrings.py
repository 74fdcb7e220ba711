"""Removal of repeated substrings across documents with suffix arrays over content-made shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shingles import text_bytes
from millrace.llm.suffix_array import permuted_common_prefixes, suffix_array
from millrace.storage import staged

#: Bytes of a repeated string; bytes of the grams whose least hash in a string is its shard key.
LENGTH, GRAM = 50, 20
#: Distinct bytes that one suffix array covers, unless a single key has more.
SHARD_BYTES = 1 << 20
#: Keys a map task gathers before it sends them; bytes that are hashed at once, few enough for the processor's
#: cache; bytes of segments, or strings of them, that are laid out at once.
FLUSH, PIECE, PORTION = 1_000_000, 1 << 14, 1 << 18
_P = np.uint64(0x9E3779B97F4A7C17 | 3)
_TABLE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64)


#: Their product is GRAM.
_STEPS = (2, 5, 2)


def _mixed(x: np.ndarray) -> np.ndarray:
    """``mixed`` in place."""
    s = np.empty_like(x)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(by), out=s)
        x ^= s
        x *= np.uint64(times)
    np.right_shift(x, np.uint64(31), out=s)
    x ^= s
    return x


def _keys_at(data: np.ndarray) -> np.ndarray:
    """The key of each ``LENGTH``-byte string: the least hash of the ``GRAM``-byte grams in it."""
    # grams of 1, 2, 5, 10 and GRAM bytes, each of two or more of the size before
    h, size = _TABLE[data], 1
    for times in _STEPS:
        wide, shift, m = h, np.uint64(pow(int(_P), size, 1 << 64)), len(h) - size * (times - 1)
        h = h[:m] * shift
        for k in range(1, times):
            h += wide[size * k : size * k + m]
            if k + 1 < times:
                h *= shift
        size *= times
    low, width, need = _mixed(h), 1, LENGTH - GRAM + 1
    while width < need:
        step = min(width, need - width)
        low = np.minimum(low[: len(low) - step], low[step:])
        width += step
    return low


def key_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive ``LENGTH``-byte strings of a text with the same key: (text, key, first start, number).

    Equal strings have equal keys wherever they stand. ``offsets`` are the
    n + 1 places of the texts in ``data``; starts count from the text's own.
    """
    texts, keys, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    last = np.uint64(0)
    for lo in range(0, len(data) - LENGTH + 1, PIECE):
        low = _keys_at(data[lo : lo + PIECE + LENGTH - 1])
        new = np.r_[low[0] != last, low[1:] != low[:-1]]
        a, b = np.searchsorted(offsets, (lo, lo + len(low)))
        new[offsets[a:b] - lo] = True
        last = low[-1]
        at = np.flatnonzero(new)
        text = np.searchsorted(offsets, at + lo, "right") - 1
        whole = at + lo + LENGTH <= offsets[text + 1]
        at, text = at[whole], text[whole]
        for c, x in zip((texts, keys, firsts), (text, low[at], at + lo - offsets[text])):
            c.append(x)
    text, key, first = np.concatenate(texts), np.concatenate(keys), np.concatenate(firsts)
    after = np.diff(offsets)[text] - LENGTH + 1  # a run ends where the next begins, or with the text's strings
    after[:-1] = np.where(text[1:] == text[:-1], first[1:], after[:-1])
    return text, key, first, after - first


def _keys(buckets: int):
    """Texts to one row per bucket: the keys (upper half) of the texts, and whose they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, keys, texts = [], [], [], []
        held = base = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            i, m, k, at = (np.concatenate(c) for c in (ids, marks, keys, texts))
            to = (k % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int32)
            order = np.argsort(to, kind="stable")
            k, at, to = (k[order] >> np.uint64(32)).astype(np.uint32), at[order], to[order]
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for a, b in zip(edge, np.r_[edge[1:], len(k)]):
                new = np.r_[True, at[a + 1 : b] != at[a : b - 1]]
                used, local = at[a:b][new], np.cumsum(new) - 1
                row = [i[used].tobytes(), m[used].tobytes(), k[a:b].tobytes(), local.astype(np.uint32).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(to[a])], pa.int32()), *[pa.array([x], pa.binary()) for x in row]],
                    names=["bucket", "ids", "marks", "keys", "at"],
                )
            for x in (ids, marks, keys, texts):
                x.clear()

        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                text, key, _, _ = key_runs(*text_bytes(part.column(2)))
                order = np.argsort(key)
                order = order[np.argsort(text[order].astype(np.uint16), kind="stable")]
                text, key = text[order], key[order]
                new = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)]
                keys.append(key[new])
                texts.append(text[new] + base)
                ids.append(part.column(0).to_numpy().copy())  # a copy does not hold the batch
                marks.append(part.column(1).to_numpy().copy())
                base += len(part)
                held += len(keys[-1])
                if held > FLUSH:
                    yield from flush()
                    held = base = 0
        yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text those of its keys that other documents have as well."""
    cols: list[list[np.ndarray]] = [[], [], [], []]
    base = 0
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("ids", "marks", "keys", "at")]):
            i, m, k, at = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int64, np.uint32, np.uint32)))
            for c, x in zip(cols, (i, m, k, at.astype(np.int64) + base)):
                c.append(x)
            base += len(i)
    if not base:
        return
    ids, marks, k, at = (np.concatenate(c) for c in cols)
    order = np.argsort(k, kind="stable")
    k, at = k[order], at[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    least, most = np.minimum.reduceat(ids[at], first), np.maximum.reduceat(ids[at], first)
    keep = np.repeat(least != most, np.diff(np.r_[first, len(k)]))
    k, at = k[keep], at[keep]
    order = np.argsort(at, kind="stable")
    k, at = k[order], at[order]
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    ends = np.r_[edge[1:], len(at)]
    for lo in range(0, len(edge), 10_000):
        e = edge[lo : lo + 10_000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids[at[e]]),
                pa.array(marks[at[e]]),
                pa.array([k[a:b].tobytes() for a, b in zip(e, ends[lo : lo + 10_000])], pa.binary()),
            ],
            names=["doc_id", "mark", "keys"],
        )


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of ``start[k]`` to ``start[k] + n[k]``, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


def _portions(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive items of about ``most`` in all, one item at least."""
    piece = (np.cumsum(sizes) - sizes) // most
    edge = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if len(sizes) else []
    for a, b in zip(edge, [*edge[1:], len(sizes)]):
        yield slice(int(a), int(b))


def _segments(buckets: int):
    """Texts with their shared keys to one row per run of strings with such a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 200):
                part = b.slice(lo, 200)
                data, offsets = text_bytes(part.column("text"))
                text, key, start, n = key_runs(data, offsets)
                lists = [b"".join(x) for x in part.column("keys").to_pylist()]
                whose = np.repeat(np.arange(len(part), dtype=np.uint64) << np.uint64(32), [len(x) // 4 for x in lists])
                want = np.unique(whose | np.frombuffer(b"".join(lists), np.uint32))
                mine = text.astype(np.uint64) << np.uint64(32) | key >> np.uint64(32)
                ok = want[np.minimum(np.searchsorted(want, mine), len(want) - 1)] == mine if len(want) else np.zeros(len(mine), bool)
                text, key, start, size = text[ok], key[ok], start[ok], n[ok] + LENGTH - 1
                ids, marks = part.column("doc_id").to_numpy(), part.column("mark").to_numpy()
                for s in _portions(size, PORTION):
                    raw = data[_ranges(offsets[text[s]] + start[s], size[s])]
                    ends = np.r_[0, np.cumsum(size[s])].astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array((key[s] % np.uint64(buckets)).astype(np.int32)),
                            pa.array(key[s].view(np.int64)),
                            pa.array(ids[text[s]]),
                            pa.array(marks[text[s]]),
                            pa.array(start[s].astype(np.int32)),
                            pa.Array.from_buffers(pa.binary(), len(size[s]), [None, pa.py_buffer(ends), pa.py_buffer(raw)]),
                        ],
                        names=["bucket", "key", "doc_id", "mark", "start", "bytes"],
                    )

    return run


def repeated_in_shard(t: np.ndarray, sizes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each string of each segment, one after the other, the smallest owner of a segment that has the string.

    ``t`` holds the segments end to end. One suffix array over all of them
    brings equal strings together: those whose neighbours share ``LENGTH`` bytes.
    """
    strings = sizes - LENGTH + 1
    at = _ranges(np.cumsum(sizes) - sizes, strings)
    whole = np.zeros(len(t), bool)
    whole[at] = True
    order = suffix_array(t, LENGTH, whole)
    first = np.flatnonzero(permuted_common_prefixes(t, order, LENGTH)[order] < LENGTH)
    owners = np.zeros(len(t), np.int64)
    owners[at] = np.repeat(owner, strings)
    least = np.empty(len(t), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owners[order], first), np.diff(np.r_[first, len(order)]))
    return least[at]


def _spans(distinct: pa.Array, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The spans of a shard's rows (segment, doc_id, mark, start) that an earlier document has."""
    segment, ids, marks, starts = rows
    t, offsets = text_bytes(distinct)
    sizes = np.diff(offsets)
    owner = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(owner, segment, ids)
    least = repeated_in_shard(t, sizes, owner)
    strings = sizes - LENGTH + 1
    begin = np.cumsum(strings) - strings
    low, high = np.minimum.reduceat(least, begin), np.maximum.reduceat(least, begin)
    whole = np.flatnonzero(high[segment] < ids)
    some = np.flatnonzero((low[segment] < ids) & (high[segment] >= ids))
    out = [(whole, np.zeros(len(whole), np.int64), sizes[segment[whole]])]
    for s in _portions(strings[segment[some]], PORTION):
        row = some[s]
        n = strings[segment[row]]
        hit = least[_ranges(begin[segment[row]], n)] < np.repeat(ids[row], n)
        ends = np.cumsum(n)
        new, end = hit.copy(), hit.copy()  # where a run of hits begins and ends; none goes on into the next row
        cut = np.zeros(len(hit) + 1, bool)
        cut[ends] = True
        new[1:] &= ~hit[:-1] | cut[1:-1]
        end[:-1] &= ~hit[1:] | cut[1:-1]
        a, b = np.flatnonzero(new), np.flatnonzero(end)
        of = np.searchsorted(ends, a, "right")
        out.append((row[of], a - (ends - n)[of], b - (ends - n)[of] + LENGTH))
    row, a, b = (np.concatenate(c) for c in zip(*out))
    if len(row):
        cols = (ids[row], marks[row], (starts[row] + a).astype(np.int32), (starts[row] + b).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "mark", "start", "end"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to spans (doc_id, mark, start, end) that an earlier document has."""
    distinct: list[pa.Array] = []
    rows: list[list[np.ndarray]] = [[], [], [], []]
    size = merged = count = 0
    last = None

    def merge() -> None:
        """Equal segments of the parts become one."""
        nonlocal size, merged, count
        if len(distinct) > 1:
            one = pa.concat_arrays(distinct).dictionary_encode()
            distinct[:] = [one.dictionary]
            rows[0][:] = [one.indices.to_numpy()[np.concatenate(rows[0])]]
        merged = size = text_bytes(distinct[0])[1][-1]
        count = len(distinct[0])

    for b in batches:
        if not len(b):
            continue
        key, raw = b.column("key").to_numpy(), b.column("bytes")
        sizes = np.diff(text_bytes(raw)[1])
        # parts of whole keys; the first goes on with the last key, if that goes on
        new = np.flatnonzero(np.r_[key[0] != last, key[1:] != key[:-1]])
        piece = np.cumsum(sizes)[new] // SHARD_BYTES
        edge = np.unique(np.r_[0, new[np.r_[True, piece[1:] != piece[:-1]][: len(new)]]])
        for lo, hi in zip(edge, np.r_[edge[1:], len(key)]):
            if key[lo] != last and size > SHARD_BYTES:
                merge()
                if size > SHARD_BYTES:
                    yield from _spans(distinct[0], [np.concatenate(c) for c in rows])
                    for c in (distinct, *rows):
                        c.clear()
                    size = merged = count = 0
            part = raw.slice(lo, hi - lo).dictionary_encode()
            for c, x in zip(rows, (part.indices, *(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "mark", "start")))):
                c.append(x.to_numpy().astype(np.int64))  # a copy, which does not hold the batch
            rows[0][-1] += count
            distinct.append(part.dictionary)
            count += len(part.dictionary)
            size += int(text_bytes(part.dictionary)[1][-1])
            last = key[hi - 1]
            if size > 2 * merged + 4 * SHARD_BYTES:  # a key with many rows
                merge()
    if distinct:
        merge()
        yield from _spans(distinct[0], [np.concatenate(c) for c in rows])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and their spans to what is removed and the digest of what is kept."""
    for b in batches:
        for s in _portions(np.diff(text_bytes(b.column("text"))[1]), PORTION):
            part = b.slice(s.start, s.stop - s.start)
            data, offsets = text_bytes(part.column("text"))
            size = np.diff(offsets)
            spans, copied = part.column("spans"), part.column("copied").to_numpy(zero_copy_only=False) & (size >= LENGTH)
            each = spans.flatten()
            at = np.repeat(offsets[:-1], spans.value_lengths().fill_null(0).to_numpy())
            edges = np.zeros(len(data) + 1, np.int32)
            np.add.at(edges, at + each.field("start").to_numpy(), 1)
            np.add.at(edges, at + each.field("end").to_numpy(), -1)
            np.add.at(edges, offsets[:-1][copied], 1)
            np.add.at(edges, offsets[1:][copied], -1)
            gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
            new = gone.copy()
            new[1:] &= ~gone[:-1]
            heads = offsets[:-1][size > 0]
            new[heads] = gone[heads]
            removed, runs = (np.diff(np.r_[0, np.cumsum(x)][offsets]) for x in (gone, new))
            kept, ends = memoryview(data[~gone]), np.r_[0, np.cumsum(size - removed)]
            digests = [hashlib.sha256(kept[x:y]).hexdigest() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *map(pa.array, (size, removed, runs, digests))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): each row with whether a smaller id has the same text, and the repeated spans of the rest.

    Rows carry ``mark``, a hash of id and text that tells repeated ids apart.
    """
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("mark", F.xxhash64("doc_id", "text"))
    slim = texts.select("doc_id", "mark", F.unhex(F.sha2("text", 256)).alias("sha")).distinct()
    least = slim.groupBy("sha").agg(F.min("doc_id").alias("head"))
    rows = staged(
        slim.join(least, "sha").select("doc_id", "mark", (F.col("doc_id") > F.col("head")).alias("copied")), "substr-rows"
    )
    heads = rows.where(~F.col("copied")).select("doc_id", "mark")
    keyed = texts.join(heads, ["doc_id", "mark"], "left_semi").select("doc_id", "mark", "text")
    signed = keyed.mapInArrow(_keys(buckets), "bucket int, ids binary, marks binary, keys binary, at binary")
    shared = staged(
        signed.repartition(buckets, "bucket").mapInArrow(_shared, "doc_id long, mark long, keys binary"), "substr-keys"
    )
    wanted = shared.groupBy("doc_id", "mark").agg(F.collect_list("keys").alias("keys"))
    segments = (
        texts.join(wanted, ["doc_id", "mark"])
        .select("doc_id", "mark", "text", "keys")
        .mapInArrow(_segments(buckets), "bucket int, key long, doc_id long, mark long, start int, bytes binary")
    )
    spans = staged(
        segments.repartition(buckets, "bucket")
        .sortWithinPartitions("key")
        .mapInArrow(_shards, "doc_id long, mark long, start int, end int"),
        "substr-spans",
    )
    return rows, spans


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and kept_sha256.

    A byte goes if a 50-byte string over it also starts in a row with a
    smaller id; strings are judged on the input. Null texts are empty; texts
    under 50 bytes lose nothing; rows with equal ids do not remove each other's
    bytes, and a null id counts as the smallest.

    Steps: rows whose whole text a smaller id has are settled by digests. Of
    the others, the keys of all 50-byte strings (the least hash of their
    20-byte grams) are matched across documents; runs of strings with a shared
    key go to the shard of the key, where one suffix array a megabyte of
    distinct segments finds the equal strings and the smallest document of
    each. Shards hold whole keys, so no match crosses two of them.
    """
    rows, spans = repeated_spans(docs, id_col, text_col)
    lists = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    marked = rows.join(lists, ["doc_id", "mark"], "left")
    texts = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"),
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("mark", F.xxhash64("doc_id", "text"))
    return (
        texts.join(marked, ["doc_id", "mark"])
        .select(F.col("id").alias("doc_id"), "text", "copied", "spans")
        .mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    )
