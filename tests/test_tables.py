"""Tables that change by commits, rules with nulls, and reports."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import relational as R
from millrace.sources import sinks
from millrace.sources.tables import Conflict, Table


def test_commits_are_atomic_and_guarded(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t = Table(spark, str(tmp_path / "t"), rows.schema)
    assert t.version() == 0 and t.read().count() == 0
    t.insert_new(rows, ["k"], [F.col("v")])
    since = t.version()
    t.commit(rows.limit(1), since)
    with pytest.raises(Conflict):
        t.commit(rows, since)
    assert t.version() == 2 and t.read().count() == 1 and t.read(1).count() == 2


def test_changes_repeat_without_effect(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k int, v string")
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "k int, v string")
    got = lambda: sorted((r.k, r.v or "") for r in t.read().collect())
    for _ in range(2):
        t.insert_new(batch, ["k"], [F.col("v")])
        assert got() == [(1, "a"), (2, "c"), (3, "")]
    for _ in range(2):
        t.replace_by_key(batch.where("v = 'b'"), ["k"])
        assert got() == [(1, "b"), (2, "c"), (3, "")]
    for _ in range(2):
        t.delete_matching(batch.where("v = 'c'"), ["k"])
        assert got() == [(1, "b"), (3, "")]
    for _ in range(2):
        t.update_where_absent(batch.where("k = 1"), ["k"], v=F.lit("z"))
        assert got() == [(1, "b"), (3, "z")]


def test_not_in_with_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    right = spark.createDataFrame([(1,), (None,)], "b int")
    kept = lambda r: sorted(-1 if x.a is None else x.a for x in R.not_in(left, "a", r, "b").collect())
    assert kept(right) == [] and kept(right.where("b = 1")) == [2] and kept(right.limit(0)) == [-1, 1, 2]


def test_validity_and_staleness(spark):
    rows = spark.createDataFrame([("2024-01-01", "2024-02-01", "2023-12-02"), ("2024-01-01", None, "soon"), ("2024-03-01", None, None)], "a string, z string, c string")
    on = F.lit("2024-01-31").cast("date")
    got = rows.select(R.currently_valid(on, F.to_date("a"), F.to_date("z")).alias("ok"), R.staleness_days(on, F.col("c")).alias("days")).collect()
    assert [(r.ok, r.days) for r in got] == [(True, 60), (True, 10_000), (False, 10_000)]


def test_reports_replace_what_is_there(spark, tmp_path):
    path = str(tmp_path / "r.json")
    for n in (1, 2):
        sinks.report(spark.createDataFrame([(n,)], "n int"), path)
        assert json.load(open(path)) == [{"n": n}]
