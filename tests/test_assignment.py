"""Batches into persisted groups: nothing that is persisted changes, no component leaks, bridges are held back."""

from pyspark.sql import functions as F

from millrace.operators import graph
from millrace.plans import curation


def test_batches(spark):
    rows = []
    for i in range(240):
        observer = f"o{i % 60}"
        rows.append((i, f"{i:04x}", i % 2, observer, f"{observer}/{i // 120}", f"n{i % 97}" if i % 5 == 0 else None))
    # a bridge: the last content is near two earlier ones of different observers and another that joins one group
    links = spark.createDataFrame(rows, "i int, sha string, taxon int, observer string, observation string, near string")
    early, late = F.col("i") < 160, F.col("i") >= 160
    first = curation.assignment_batches(spark, links, [early])
    groups, members, held = curation.assignment_batches(spark, links, [early, late])
    before = {r.group_id: r.split for r in first[0].read().collect()}
    after = {r.group_id: r.split for r in groups.read().collect()}
    assert before and before == {g: s for g, s in after.items() if g in before} and len(after) >= len(before)
    group = {r.sha: r.group_id for r in members.read().collect()}
    assert {r.sha: r.group_id for r in first[1].read().collect()}.items() <= group.items()
    roots = {r.node: r.root for r in graph.labelled(links.select(F.col("sha").alias("node")), graph.leak_edges(links, "observation", "near")).collect()}
    touched = {}
    for sha, g in group.items():
        touched.setdefault(roots[sha], set()).add(after[g])
    out = {r.sha: r.reason for r in held.read().collect()}
    assert set(out) | set(group) == {r[1] for r in rows} and not set(out) & set(group)
    for sha in out:  # held back only where the component's groups are in different splits, and late
        assert int(sha, 16) >= 160 and len(touched[roots[sha]]) > 1
    for sha in group:
        if int(sha, 16) >= 160:
            assert len(touched[roots[sha]]) == 1


def test_stars_join_groups_and_nulls_do_not(spark):
    rows = spark.createDataFrame([("a", "x", None), ("b", "x", None), ("c", "y", "n"), ("d", None, "n")], "sha string, g string, h string")
    assert {tuple(r) for r in graph.leak_edges(rows, "g", "h").collect()} == {("a", "b"), ("c", "d")}


def test_steps_are_short_and_broadcast_nothing_by_its_files(spark, monkeypatch):
    """Files of numbers say little about their rows, and what is broadcast is on the driver; so is every plan."""
    plans = {}

    def kept(df, name, stage=curation.staged):
        plans.setdefault(name, []).append(df._jdf.queryExecution().sparkPlan().toString())
        return stage(df, name)

    monkeypatch.setattr(curation, "staged", kept)
    monkeypatch.setattr(graph, "staged", kept)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    rows = [(i, f"{i:04x}", i % 2, f"o{i % 6}", f"o{i % 6}/{i // 12}", f"n{i % 7}" if i % 5 == 0 else None) for i in range(24)]
    links = spark.createDataFrame(rows, "i int, sha string, taxon int, observer string, observation string, near string")
    curation.assignment_batches(spark, links, [F.col("i") < 20, F.col("i") >= 20])
    assert before == [spark.conf.get(k, None) for k in keys]
    assert {"assign-rows", "assign-groups", "assign-members", "cc"} <= set(plans)
    for name, of in plans.items():
        for p in of:
            joins = [line for line in p.split("\n") if "Join" in line]
            assert name == "assign-nodes" or not [j for j in joins if "Broadcast" in j], name  # its broadcast is a row for each partition
            assert len(joins) <= 4, name
