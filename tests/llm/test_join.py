"""The similarity join's trees, blocks and rounds against brute force."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import ngram_join
from millrace.llm.rtree import CountTree

from .conftest import SCHEMA
from .test_free import brute_groups, shingles


def test_tree_finds_all_pairs_that_the_bound_allows():
    rng = np.random.default_rng(2)
    for m in (25, 700):
        base = rng.integers(0, 5, (40, 16))
        counts = np.maximum(base[rng.integers(0, 40, m)] + rng.integers(-1, 2, (m, 16)), 0)
        n = counts.sum(1)
        tree, whole = CountTree(counts, n), np.ones(m, bool)
        if not tree.levels:
            got = set(zip(*tree.leaf_pairs(3, 4, np.ones((m, m), bool))))
        else:
            got = {(min(i, int(j)), max(i, int(j))) for i in range(m) for j in tree.search(counts[i], int(n[i]), 3, 4, whole) if i != j}
        bound = np.minimum(counts[:, None], counts[None]).sum(2)
        i, j = np.nonzero(np.triu((7 * bound >= 3 * (n[:, None] + n[None])) & (4 * np.minimum(n[:, None], n[None]) >= 3 * np.maximum(n[:, None], n[None])), 1))
        assert got == set(zip(i, j))


def test_counts_beyond_a_byte_are_not_clamped():
    s = np.arange(40_000, dtype=np.uint64)  # all in one group
    raw = ngram_join._counted(s, 7)
    assert ngram_join._counts(raw, 7)[0] == 40_000
    tree = CountTree(np.array([ngram_join._counts(raw, 7)] * 2), np.array([40_000] * 2))
    assert len(tree.leaf_pairs(3, 4, np.ones((2, 2), bool))[0]) == 1


def family(rng, size, near, edits):
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base, rows = [word() for _ in range(size)], []
    for i in range(near):
        w = list(base)
        for _ in range(rng.randint(1, edits)):
            w[rng.randrange(size)] = word()
        rows.append(" ".join(w))
    return rows


def test_families_within_and_beyond_the_threshold(spark, monkeypatch):
    """Members that link to some of a family only: chains, forests with failed pairs, tiles of one block."""
    rng = random.Random(11)
    texts = family(rng, 120, 50, 5) + family(rng, 60, 40, 3)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    docs, want = spark.createDataFrame(rows, SCHEMA).repartition(5), brute_groups(rows)
    monkeypatch.setattr(ngram_join, "WIDE", 24)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(docs).collect()}
    assert got == want


def test_large_family_of_near_copies(spark):
    rng = random.Random(12)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(family(rng, 60, 5000, 1))]
    got = ngram_join.similarity_groups(spark.createDataFrame(rows, SCHEMA).repartition(8))
    assert got.select("component_id").distinct().collect() == [(0,)]


def test_exactly_at_the_threshold(spark):
    """21 shingles with 18 in common make 18 / 24, which links; 17 in common do not."""
    w = [f"w{i}" for i in range(25)]
    at, under = w[:22] + ["x", "y", "z"], w[:21] + ["p", "q", "r", "s"]
    rows = [(1, " ".join(w), "en", "s", 0), (2, " ".join(at), "en", "s", 0), (3, " ".join(under), "en", "s", 0)]
    assert len(shingles(rows[0][1]) & shingles(rows[1][1])) == 18 and len(shingles(rows[0][1]) | shingles(rows[1][1])) == 24
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_links_are_all_pairs_of_different_sets(spark, docs, rows):
    members, links = ngram_join.similarity_links(docs)
    ids = {}
    for r in members.collect():
        ids.setdefault(bytes(r.node), []).append(r.doc_id)
    got = {frozenset((min(ids[bytes(r.u)]), min(ids[bytes(r.v)]))) for r in links.collect()}
    sets, want = {r[0]: shingles(r[1]) for r in rows}, set()
    heads = {min(i for i, s in sets.items() if s == t) for t in sets.values() if t}
    for i in heads:
        for j in heads:
            if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                want.add(frozenset((i, j)))
    assert got == want and len(want) > 5


def test_removing_the_tree_changes_the_result(spark, docs, rows, monkeypatch):
    def none(spanning):
        return lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int64(), pa.binary(), pa.binary())], names=["key", "u", "v"])])

    monkeypatch.setattr(ngram_join, "_tree_pairs", none)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similarity_groups(docs).collect()}
    assert got != brute_groups(rows)


def test_keep_one_with_repeated_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten " * 3
    near = text + "more"
    rows = [(3, text), (7, near), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, near + " and"), (None, "x y z"), (None, "x y z"), (5, ""), (5, ""), (6, None)]
    df = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], SCHEMA)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in ngram_join.keep_one(df).collect())
    assert got == sorted([(3, text), (7, "a b c d e f g"), (-1, "x y z"), (5, ""), (5, ""), (6, "")])


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(3)
    long = " ".join(str(rng.randrange(10**9)) for _ in range(60_000))
    rows = [(1, long, 0, 0, 0), (2, long + " end", 0, 0, 0), (3, "short text of six words here", 0, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _row int, node int")
    assert {r.doc_id: r.component_id for r in ngram_join.similarity_groups(df).collect()} == {1: 1, 2: 1, 3: 3}
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert ngram_join.keep_one(df.where(F.lit(False))).count() == 0
