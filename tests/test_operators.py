import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation, graph, relational, similarity, splits
from millrace.plans import catalog


def test_hamming_pairs_equal_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(63) for _ in range(30)]
    rows = [(i, base[i % 30] ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(9)))) for i in range(150)]
    rows = [(i, h & (2**63 - 1)) for i, h in rows] + [(900, None)]
    got = {(r.a, r.b) for r in similarity.hamming_pairs(spark.createDataFrame(rows, "id long, h long"), "id", "h").collect()}
    known = [r for r in rows if r[1] is not None]
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(known, 2) if 0 < bin(x ^ y).count("1") <= 6 or x == y and a == min(i for i, h in known if h == x)}
    firsts = {h: min(i for i, g in known if g == h) for _, h in known}
    want = {(min(firsts[dict(known)[a]], firsts[dict(known)[b]]), max(firsts[dict(known)[a]], firsts[dict(known)[b]])) if dict(known)[a] != dict(known)[b] else (a, b) for a, b in want}
    assert got == want


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = dict(graph.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_components_of_all_line_items_equal_union_find(spark, tmp_path):
    rng = random.Random(5)
    # keys that agree modulo 500 or 700, orders and parts of the same number, and all quantities and discounts
    items = [(o + 500 * rng.randrange(5), p + 700 * rng.randrange(5), q, q / 100) for o in range(1, 13) for p in rng.sample(range(1, 40), 1) for q in (1, 5)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for o, p, *_ in items:
        a, b = sorted((find(2 * o), find(2 * p + 1)))
        parent[b] = a
    want = {x: find(x) for x in parent}
    assert len(set(want.values())) > 3
    got = catalog.QUERIES["g1_components"](spark, str(tmp_path)).collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want


def test_merged_ids_resolve_and_cycles_raise(spark):
    r = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3)], "id long, merged_into long")
    assert dict(relational.resolve_merged(r).collect()) == {1: 1, 2: 1, 3: 1, 4: 1}
    with pytest.raises(ValueError):
        relational.resolve_merged(spark.createDataFrame([(1, 2), (2, 1)], "id long, merged_into long"))


def _links(spark, n, observers=40, taxa=2):
    rows = [(f"{i:08x}", i % taxa, f"o{i * 7 % observers}") for i in range(n)]
    return spark.createDataFrame(rows, "sha string, taxon int, observer string")


GROUPS = "group_id string, taxon int, split string, observers array<string>, assigned_at long"


def test_assignment_is_immutable_and_leak_free(spark):
    links = _links(spark, 300)
    roots = links.select(F.col("sha").alias("node"), F.col("sha").alias("root"))
    none = spark.createDataFrame([], GROUPS), spark.createDataFrame([], "sha string, group_id string")
    groups, members, quarantine = splits.assign(links, roots, *none)
    rows = groups.collect()
    assert len(rows) == 300 and quarantine.count() == 0
    assert {r.split for r in rows} == {"train", "validation", "dev_test", "final_test"}
    by_observer = {}
    for r in rows:
        by_observer.setdefault((r.taxon, r.observers[0]), set()).add(r.split)
    assert all(len(s) == 1 for s in by_observer.values())
    kept = spark.createDataFrame([(r.group_id, r.taxon, r.split, r.observers, 1) for r in rows], GROUPS)
    again, more, held = splits.assign(links, roots, kept, members)
    assert again.count() == more.count() == held.count() == 0


def test_bridges_are_quarantined(spark):
    groups = spark.createDataFrame([("a", 1, "train", ["x"], 1), ("b", 1, "final_test", ["y"], 1)], GROUPS)
    members = spark.createDataFrame([("a", "a"), ("b", "b")], "sha string, group_id string")
    links = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], "sha string, taxon int, observer string")
    roots = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "a")], "node string, root string")
    new, joined, held = splits.assign(links, roots, groups, members)
    assert new.count() == 0 and joined.count() == 0
    assert [tuple(r) for r in held.collect()] == [("c", "bridges_split_conflict", "a=train, b=final_test")]


def test_thin_class_trains(spark):
    links = _links(spark, 3, taxa=1)
    roots = links.select(F.col("sha").alias("node"), F.col("sha").alias("root"))
    new, _, _ = splits.assign(links, roots, spark.createDataFrame([], GROUPS), spark.createDataFrame([], "sha string, group_id string"))
    assert {(r.split, r.rule) for r in new.collect()} == {("train", "thin_class")}


def test_temperature(spark):
    rows = [([4.0, 0.0], 0)] * 9 + [([4.0, 0.0], 1)]
    t = evaluation.temperature(spark.createDataFrame(rows, "logits array<double>, label int"))
    assert abs(t - 4 / 2.1972) < 0.02
