"""Exact similarity join of word shingles at a Jaccard threshold, by count-vector R-trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import components
from millrace.llm.rtree import CountTree
from millrace.llm.shingles import shingle_sets
from millrace.storage import release, staged

WIDTH = 5
#: Similarity of 0.75 as a fraction.
NUM, DEN = 3, 4
#: Keys a map task gathers before it sends them; nodes of one tree beyond which a block is tiled.
FLUSH, WIDE = 1_000_000, 1024
#: Values that are told apart as frequent, at most (36 MB).
FREQUENT = 4_000_000
#: Text bytes whose prefix values one bucket gathers; partners of a set that one task joins.
BUCKET_BYTES, PARTNERS = 32 << 20, 512

_ROWS = "bucket int, doc_id long, row long, n int, node binary, point binary, nodes binary, keys binary, at binary"
_ARROW = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
_NAMES = ["bucket", "doc_id", "row", "n", "node", "point", "nodes", "keys", "at"]
_BLOCKS = "kind int, doc_id long, row long, n int, node binary, point binary, key long, width int, block binary, head boolean"
_PAIRS = "u binary, v binary"


def _prefix(n: int) -> int:
    """Two sets that are similar enough share a value among the first so many of each, in any common order."""
    return n - -(-NUM * n // DEN) + 1


def _node(s: np.ndarray) -> bytes:
    """16 bytes that name a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b"\0" * 16


def _frequent(width: int):
    """Values that several sets of a task share, with their number there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k[n > 2].view(np.int64)), pa.array(n[n > 2])], names=["key", "n"])
            held.clear()
            seen.clear()

        for b in batches:
            for lo in range(0, len(b), 500):
                for s in shingle_sets(b.slice(lo, 500).column(0), width):
                    name = _node(s)
                    if len(s) and name not in seen:
                        seen.add(name)
                        held.append(s)
                        size += len(s)
                if size > 2 * FLUSH:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def frequent_values(docs: DataFrame, text_col: str, width: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values that many sets share, and the log2 of their number: none with fewer than 16, and ``most`` at most.

    Only counts that reach 1 / ``most`` of all counted are kept, so there can be
    no more than ``most`` of them. They merely order the values of a set, the
    frequent last; any order gives the same links.
    """
    counts = staged(
        docs.select(text_col).mapInArrow(_frequent(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")),
        "join-frequent",
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    got = counts.where(F.col("n") >= max(16, -(-total // most))).select("key", F.floor(F.log2("n")).cast("tinyint").alias("c")).toArrow()
    release(counts)
    key, rank = np.asarray(got.column("key").combine_chunks()).view(np.uint64), np.asarray(got.column("c").combine_chunks())
    order = np.argsort(key)
    return key[order], rank[order]


def _rare_first(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The values of a set, the more frequent ones behind the others."""
    frequent, rank = common
    if not len(frequent) or not len(s):
        return s
    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
    often = np.where(frequent[at] == s, rank[at], 0)
    return s[np.argsort(often, kind="stable")] if often.any() else s


def _bits(n: np.ndarray) -> np.ndarray:
    """log2 of the groups that the values of sets of size ``n`` fall into: two to four values a group, 128 groups at least."""
    return np.maximum(7, np.frexp((np.asarray(n) >> 2).astype(np.float64))[1])


def _counted(s: np.ndarray, bits: int) -> bytes:
    """How many values fall into each group: a byte a group, or four where one does not hold them."""
    c = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return c.astype(np.uint8 if c.max() < 256 else np.uint32).tobytes()


def _counts(x: bytes, bits: int) -> np.ndarray:
    return np.frombuffer(x, np.uint8 if len(x) == 1 << bits else np.uint32)


def _folded(c: np.ndarray) -> np.ndarray:
    """Counts in half as many groups."""
    wide = c[::2].astype(np.uint16 if c.dtype == np.uint8 else np.uint32)
    return wide + c[1::2]


def _signer(width: int, buckets: int, common):
    """Texts to document rows, and per bucket the prefix values with the sets they come from.

    Equal sets within a task are sent once. Values go out as arrays, one row
    for each bucket, for single rows would cost more than their payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[bytes, int] = {}
        keys: list[np.ndarray] = []
        held = 0

        def rows(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW)], names=_NAMES)

        def flush() -> Iterator[pa.RecordBatch]:
            if not keys:
                return
            k = np.concatenate(keys)
            at = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) for x in keys])
            to = (k % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            k, at, to = k[order], at[order], to[order]
            names = np.frombuffer(b"".join(nodes), dtype="V16")
            edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            for a, b in zip(edge, np.r_[edge[1:], len(k)]):
                used, local = np.unique(at[a:b], return_inverse=True)
                yield rows(
                    [[int(to[a])], *[[None]] * 5]
                    + [[names[used].tobytes()], [k[a:b].tobytes()], [local.astype(np.uint32).tobytes()]]
                )
            nodes.clear()
            keys.clear()

        for b in batches:
            for lo in range(0, len(b), 500):
                part = b.slice(lo, 500)
                sets = shingle_sets(part.column(1), width)
                ids, n = [_node(s) for s in sets], len(sets)
                bits = _bits([len(s) for s in sets]).tolist()
                for s, name in zip(sets, ids):
                    if len(s) and name not in nodes:
                        nodes[name] = len(nodes)
                        keys.append(_rare_first(s, common.value)[: _prefix(len(s))])
                        held += len(keys[-1])
                own = [int.from_bytes(x[:4], "little") % buckets for x in ids]
                points = [_counted(s, k) for s, k in zip(sets, bits)]
                yield rows([own, part.column(0), part.column(2), [len(s) for s in sets], ids, points, *[[None] * n] * 3])
                if held > FLUSH:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes document rows on, and gives the block of each value that several sets have: a row a set.

    ``block`` names the sets of the block, so that values with the same sets
    can be told; ``head`` marks one row of each.
    """
    names: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    ats: list[np.ndarray] = []
    base = 0
    out = ["kind", "doc_id", "row", "n", "node", "point", "key", "width", "block", "head"]
    for b in batches:
        plain = b.filter(b.column("node").is_valid())
        if (m := len(plain)) > 0:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(m, np.int32)),
                    *[plain.column(c) for c in ("doc_id", "row", "n", "node", "point")],
                    *[pa.nulls(m, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.bool_())],
                ],
                names=out,
            )
        for nodes, k, at in zip(*[b.column(c).to_pylist() for c in ("nodes", "keys", "at")]):
            if nodes is None:
                continue
            names.append(np.frombuffer(nodes, "V16"))
            keys.append(np.frombuffer(k, np.uint64))
            ats.append(np.frombuffer(at, np.uint32).astype(np.int64) + base)
            base += len(names[-1])
    if not keys:
        return
    flat = np.concatenate(names)
    two = flat.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((two[:, 1], two[:, 0]))
    fresh = np.r_[True, (two[order][1:] != two[order][:-1]).any(axis=1)]
    same = np.empty(len(flat), np.int64)
    same[order] = np.cumsum(fresh) - 1
    uniq = flat[order][fresh]
    k, at = np.concatenate(keys), same[np.concatenate(ats)]
    order = np.lexsort((at, k))
    k, at = k[order], at[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (at[1:] != at[:-1])]
    k, at = k[new], at[new]
    more = np.zeros(len(k), bool)
    more[1:] |= k[1:] == k[:-1]
    more[:-1] |= k[1:] == k[:-1]
    k, at = k[more], at[more]
    if not len(k):
        return
    first = np.r_[True, k[1:] != k[:-1]]
    start = np.flatnonzero(first)
    width = np.diff(np.r_[start, len(k)])
    # the name of a set of sets: the sums of the two halves of their names, which are hashes
    sums = np.add.reduceat(uniq.view(np.uint64).reshape(-1, 2)[at], start, axis=0)
    block = np.repeat(np.arange(len(start)), width)
    for lo in range(0, len(k), 20_000):
        part = slice(lo, lo + 20_000)
        kk, nn, of = k[part].view(np.int64), uniq[at[part]], block[part]
        m = len(kk)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(m, np.int32)),
                *[pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32())],
                pa.array([x.tobytes() for x in nn], pa.binary()),
                pa.nulls(m, pa.binary()),
                pa.array(kk),
                pa.array(width[of].astype(np.int32)),
                pa.array([x.tobytes() for x in sums[of]], pa.binary()),
                pa.array(first[part]),
            ],
            names=out,
        )


def _tree_pairs(spanning: bool):
    """Blocks, sorted by (key, band, tile) and turn, to the pairs that a tree over their points cannot rule out.

    With ``spanning`` a set is given no pair to one that pairs of the block
    already join to it: at most one pair a set, in the order of their turns.
    Without, all pairs of different roots come out, each in the first of the
    blocks (``keys``) that both sets are in.
    """

    def block(parts: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches(parts)
        n = np.asarray(t.column("n")).astype(np.int64)
        home, part = np.asarray(t.column("home")), np.asarray(t.column("part"))
        within = bool(t.column("within")[0].as_py())
        seen: dict[bytes, int] = {}
        label = np.array([seen.setdefault(x, len(seen)) for x in t.column("root").to_pylist()])
        if len(seen) < 2:
            return []
        bits, points = _bits(n), t.column("point").to_pylist()
        key = int(np.asarray(t.column("key").slice(0, 1))[0])
        if not spanning:
            lists = t.column("keys").combine_chunks()
            edges, flat = np.asarray(lists.offsets), np.asarray(lists.values)
        out: list[tuple[int, int]] = []

        def take(a: int, b: int) -> None:
            if spanning:
                if label[a] != label[b]:
                    out.append((a, b))
                    label[label == label[b]] = label[a]
            else:
                mine, other = (flat[edges[x] : edges[x + 1]] for x in (a, b))
                if np.intersect1d(mine, other, assume_unique=True)[0] == key:
                    out.append((a, b))

        for k in np.unique(bits):
            # sets with twice as many groups are folded; two such sets meet at their own resolution
            most = n[bits == k].max()
            at = np.flatnonzero((bits == k) | ((bits == k + 1) & (NUM * n <= DEN * most)))
            if len(at) < 2:
                continue
            vectors = np.array([_counts(points[i], bits[i]) if bits[i] == k else _folded(_counts(points[i], bits[i])) for i in at])
            own, tree = bits[at] == k, CountTree(vectors, n[at])

            def allowed(i: int | slice) -> np.ndarray:
                one = at[i] if isinstance(i, int) else at[:, None]
                ok = (label[one] != label[at]) & (own[i] | own if isinstance(i, int) else own[:, None] | own) & (home[one] | home[at])
                return ok if within else ok & (part[one] != part[at])

            if not tree.levels:
                for i, j in zip(*(x.tolist() for x in tree.leaf_pairs(NUM, DEN, allowed(slice(None))))):
                    take(int(at[i]), int(at[j]))
                continue
            for i in range(len(at) - 1):
                open_ = allowed(i)
                open_[: i + 1] = False
                if open_.any():
                    for j in tree.search(vectors[i], int(n[at[i]]), NUM, DEN, open_).tolist():
                        take(int(at[i]), int(at[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[tuple[int, bytes, bytes]] = []

        def solve() -> Iterator[pa.RecordBatch]:
            if sum(map(len, held)) > 1:
                nodes = [x for b in held for x in b.column("node").to_pylist()]
                key = held[0].column("key")[0].as_py()
                made.extend((key, min(nodes[a], nodes[b]), max(nodes[a], nodes[b])) for a, b in block(held))
            held.clear()
            if len(made) > 10_000:
                yield from given()

        def given() -> Iterator[pa.RecordBatch]:
            if made:
                cols = [pa.array(c, t) for c, t in zip(zip(*made), (pa.int64(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "u", "v"])
                made.clear()

        last = None
        for b in batches:
            if not len(b):
                continue
            place = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("key", "band", "tile")], axis=1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(b)]
            for lo, hi in zip(edges, edges[1:]):
                if held and tuple(place[lo]) != last:
                    yield from solve()
                last = tuple(place[lo])
                held.append(b.slice(lo, hi - lo))
        yield from solve()
        yield from given()

    return run


def _candidates(blocks: DataFrame, nodes: DataFrame, roots: DataFrame | None, turn: int, spanning: bool) -> DataFrame:
    """(key, u, v) of the blocks (key, node, width): pairs that their trees leave.

    A block wider than ``WIDE`` is cut by size into bands, a little wider than
    the least ratio of sizes, of which two that adjoin hold any similar pair;
    and by hash into parts, with a tile of its own for every two of them. So
    no task ever holds more than some thousands of sets, and none meets twice.
    """
    full = nodes.select("node", "rep", "n", "point")
    full = full.withColumn("root", F.col("node")) if roots is None else full.join(roots, "node")
    if spanning:
        full = full.withColumn("keys", F.lit(None).cast("array<bigint>"))
    else:
        full = full.join(blocks.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys")), "node")
    rows = blocks.select("key", "node", "width").join(full, "node")
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.01 * DEN / NUM))).cast("int")
    wide = F.col("width") > WIDE
    parts = F.ceil(F.col("width") / WIDE).cast("int")
    rows = rows.withColumn("part", F.when(wide, F.pmod(F.xxhash64("node", F.lit(7)), parts)).otherwise(0).cast("int"))
    rows = rows.withColumn("band", F.explode(F.when(wide, F.array(band, band - 1)).otherwise(F.array(F.lit(-9)))))
    rows = rows.withColumn("other", F.explode(F.when(wide, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
    rows = rows.select(
        "key",
        "band",
        (F.least("part", "other") * parts + F.greatest("part", "other")).alias("tile"),
        (F.col("part") == F.col("other")).alias("_same"),
        "part",
        (~wide | (F.col("band") == band)).alias("home"),
        "node",
        "n",
        "root",
        "point",
        "keys",
        (F.col("rep") if turn == 0 else F.xxhash64("node", F.lit(turn))).alias("turn"),
        F.when(wide, parts).otherwise(1).alias("parts"),
    )
    # a tile of one part with itself compares all, a tile of two parts only across
    rows = rows.withColumn("within", F.floor(F.col("tile") / F.col("parts")) == F.pmod(F.col("tile"), F.col("parts"))).drop("_same", "parts")
    buckets = max(8, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return (
        rows.repartition(buckets, "key", "band", "tile")
        .sortWithinPartitions("key", "band", "tile", "turn", "node")
        .mapInArrow(_tree_pairs(spanning), "key long, " + _PAIRS)
    )


def _setter(width: int):
    """Texts to the names of their sets, counts in about as many groups as values, and the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 500):
                sets = shingle_sets(b.slice(lo, 500).column(0), width)
                fine = [_counted(s, _bits(len(s)) + 2) for s in sets]
                cols = [_node(s) for s in sets], [len(s) for s in sets], fine, [s.tobytes() for s in sets]
                kinds = pa.binary(), pa.int32(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["node", "m", "fine", "set"])

    return run


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both fine counts to those that their bound does not rule out."""
    for b in batches:
        keep = []
        sizes = zip(b.column("m_u").to_pylist(), b.column("m_v").to_pylist())
        for k, ((m, n), x, y) in enumerate(zip(sizes, b.column("fine_u").to_pylist(), b.column("fine_v").to_pylist())):
            p, q = _counts(x, _bits(m) + 2), _counts(y, _bits(n) + 2)
            g = min(len(p), len(q))
            p, q = (c.reshape(g, -1).sum(axis=1, dtype=np.int64) for c in (p, q))
            if (NUM + DEN) * int(np.minimum(p, q).sum()) >= NUM * (m + n):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], names=["u", "v"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both sets to those that are similar enough, counted exactly."""
    for b in batches:
        keep = []
        for k, (x, y) in enumerate(zip(b.column("set_u").to_pylist(), b.column("set_v").to_pylist())):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            if DEN * both >= NUM * (len(p) + len(q) - both):
                keep.append(k)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("u").take(at), b.column("v").take(at)], names=["u", "v"])


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Those distinct pairs of nodes whose sets are similar enough.

    A bound on fine counts comes first. Only the texts of nodes in a pair are
    read into sets again, one text a node. A set with many partners goes to
    several tasks, so many partners to each.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("_d"))
    wanted = staged(ends.select("node", F.ceil(F.col("_d") / PARTNERS).cast("int").alias("ways")), "join-wanted")
    ids = nodes.join(wanted, "node", "left_semi").select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    texts = texts.join(ids, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi").select("_text")
    sets = texts.mapInArrow(_setter(width), "node binary, m int, fine binary, set binary")
    sets = staged(sets.join(wanted, "node").dropDuplicates(["node"]), "join-sets")

    def paired(pairs: DataFrame, *columns: str) -> DataFrame:
        for e, other in (("u", "v"), ("v", "u")):
            dealt = pairs.join(wanted.select(F.col("node").alias(e), F.col("ways").alias("_ways")), e)
            dealt = dealt.withColumn("_way", F.pmod(F.xxhash64(other), F.col("_ways")).cast("int")).drop("_ways")
            spread = sets.withColumn("_way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
            pairs = dealt.join(spread.select(F.col("node").alias(e), "_way", *[F.col(c).alias(f"{c}_{e}") for c in columns]), [e, "_way"]).drop("_way")
        return pairs

    left = staged(paired(pairs, "m", "fine").mapInArrow(_finer, _PAIRS), "join-finer")
    links = staged(paired(left, "set").mapInArrow(_linked, _PAIRS), "join-links")
    release(wanted, sets, left)
    return links


def _blocked(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, blocks): each row's set, each distinct set with its count vector, and the sets of each block."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    common = spark.sparkContext.broadcast(frequent_values(docs, text_col, width))
    slim = docs.select(F.col(id_col).cast("long"), F.col(text_col), F.xxhash64(F.coalesce(text_col, F.lit(""))))
    signed = slim.mapInArrow(_signer(width, buckets, common), _ROWS)
    first = staged(signed.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared, _BLOCKS), "join-blocks")
    rows = first.where("kind = 0").select("doc_id", "row", "n", "node", "point")
    nodes = staged(
        rows.where("n > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("point").alias("point")),
        "join-nodes",
    )
    # values that the very same sets share make one block
    members = first.where("kind = 1").select("key", "node", "width", "block", "head")
    chosen = members.where("head").groupBy("block").agg(F.min("key").alias("key")).select("key")
    blocks = staged(members.select("key", "node", "width").join(chosen, "key", "left_semi"), "join-members")
    return rows.drop("point"), nodes, blocks


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``doc_id`` with the name ``node`` of its set, and all pairs (u, v) of similar sets.

    Texts with the same set are one node. Rows without words have no links.
    The rules are those of :func:`similarity_groups`; here no pair is left out,
    so a family of k different near copies gives up to k * k / 2 links.
    """
    rows, nodes, blocks = _blocked(docs, id_col, text_col, width)
    pairs = staged(_candidates(blocks, nodes, None, 0, False).select("u", "v").distinct(), "join-pairs")
    return rows.select("doc_id", "node"), _verified(pairs, docs, nodes, id_col, text_col, width)


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: doc_id, ``row`` (a hash of its text), n, and the name ``root`` of its group's least set."""
    rows, nodes, blocks = _blocked(docs, id_col, text_col, width)
    live, links, tested, roots = blocks, None, None, None
    for turn, spanning in ((0, True), (1, True), (2, False)):
        found = staged(_candidates(live, nodes, roots, turn, spanning), "join-candidates")
        pairs = found.select("u", "v").distinct()
        pairs = staged(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "join-pairs")
        new = _verified(pairs, docs, nodes, id_col, text_col, width)
        links = new if links is None else links.unionByName(new)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = nodes.select("node").join(components(links), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
        if spanning:
            # where every pair of a block's forest is a link, nothing is left to find in it
            failed = found.join(links, ["u", "v"], "left_anti").select("key").distinct()
            before, live = live, staged(live.join(failed, "key", "left_semi"), "join-live")
            release(before, found)
            if live.isEmpty():
                break
    release(live)
    return rows.join(roots, "node", "left").select("doc_id", "row", "n", "node", "root")


def similarity_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id reachable by links.

    Two texts link when their sets of ``width``-word shingles have a Jaccard
    similarity of at least 0.75; A-Z count as a-z. Null and wordless texts have
    no shingles and stand alone; texts of fewer words have one shingle. Rows
    with equal sets, repeated ids included, are one node from the start. Rows
    without an id take part and are named by the others of their group. Very
    long texts are hashed in pieces; no count is clamped. Further columns are
    ignored, whatever their names.

    Steps: (0) one pass finds values that many texts share, to order them last.
    (1) A second gives each set's count vector (two to four values a group,
    whatever the size) and sends its prefix, the first quarter of its values in
    that order, which similar sets must share a value of, to buckets; the sets
    of a shared value make a block, equal blocks one. (2) An R-tree over the
    count vectors of each block finds the sets that may be similar to each
    of its sets, by the summed minima. Each set is paired only with one that
    the block does not join to it yet, so that families of near copies cost a
    number of pairs linear in their size. (3) Pairs pass a finer bound and are
    checked on the whole sets. Blocks all of whose pairs are links are done; the
    others are searched once more in another order, and then for all pairs of
    sets that are still apart, so the result is exact.
    """
    grouped = _grouped(docs, id_col, text_col, width)
    least = grouped.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return grouped.join(least, "root", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each group of :func:`similarity_groups`, with all columns: that of the smallest id.

    Rows are told apart by id and a 64-bit hash of the text, so that a row with
    the id of another is judged on its own. Of rows that repeat both, one
    stays; a group without ids keeps the row of the least hash. Rows without
    words are no one's copies and all stay.
    """
    grouped = staged(_grouped(docs, id_col, text_col, width).where("n > 0"), "join-groups")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = grouped.groupBy("root").agg(F.min(rank).alias("best"))
    judged = grouped.join(best, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    judged = judged.groupBy("doc_id", "row").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("times"))
    judged = staged(judged.where("not stays or times > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "stays"), "join-judged")
    # whole rows travel in one column, so no name among theirs can clash
    held = docs.select(
        F.struct(*docs.columns).alias("_all"),
        F.col(id_col).cast("long").alias("_id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_row"),
    )
    same = held["_id"].eqNullSafe(judged["_id"]) & (held["_row"] == judged["_row"])
    kept = held.join(judged, same, "left_anti").select("_all")
    twice = judged.where("stays")
    if not twice.isEmpty():
        again = held.join(twice, held["_id"].eqNullSafe(twice["_id"]) & (held["_row"] == twice["_row"]), "left_semi")
        kept = kept.unionByName(again.groupBy("_id", "_row").agg(F.first("_all").alias("_all")).select("_all"))
    return kept.select("_all.*")
