"""Queries against their SQL on odd rows, and operators on cases that an earlier round missed."""

import os
import random
import shutil
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import storage
from millrace.llm import quality_ranking, suffix_array
from millrace.operators import geo
from millrace.plans import catalog, curation

DATA = "/root/testdata/sf0.001"


def _both(spark, name, at):
    """Sorted rows of the query and of its SQL over the tables in ``at``."""
    c = duckdb.connect()
    for t in os.listdir(at):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{at}/{t}'")
    df = catalog.QUERIES[name](spark, str(at))
    want = c.sql(f"select {', '.join(df.columns)} from ({catalog.ORACLE[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables, with balances that are null, not a number, infinite, far off or just below the edge of a cell."""
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    at = tmp_path_factory.mktemp("odd")
    for t in ("nation", "customer"):
        shutil.copy(f"{DATA}/{t}.parquet", at / f"{t}.parquet")
    odd = "unnest([null, 'nan', 'inf', '-inf', '1e300', '-1e300', '-5000', '20000'])::DOUBLE"
    edge = "-1000 + 11000.0::DOUBLE * range / 180 - 1e-13 * (range % 3)"
    c = duckdb.connect()
    c.execute(
        f"""copy (select * from '{DATA}/customer.parquet' union all select 10000 + range, 'x', 3, {edge}, 'y' from range(-200, 400)
        union all select 20000, 'x', 4, {odd}, 'y') to '{at}/customer.parquet'"""
    )
    return at


@pytest.mark.parametrize("name", ["a17_cells", "a18_quantise", "a19_median"])
def test_cells_of_odd_balances(spark, odd, name):
    got, want = _both(spark, name, odd)
    assert got == want


def test_pairs_of_copies_and_odd_embeddings(spark, tmp_path):
    """Families of near hashes with copies, repeated and null ids, no embedding, short ones and nulls in them."""
    rng = random.Random(4)
    sign = lambda h: [1.0 if h >> k & 1 else -1.0 for k in range(64)]
    base = [rng.getrandbits(64) for _ in range(4)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (0, 1, 3, 5)]
    rows = [(rng.randrange(1000), sign(rng.choice(near))) for _ in range(120)]
    rows += [(rows[0][0], rows[1][1]), (rows[0][0], sign(near[0])), (None, rows[2][1])]
    rows += [(2000, None), (2001, []), (2002, [None, 1.0, float("nan")]), (2003, [0.0] * 64), (2004, sign(1)), (-5, None)]
    spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/t")
    (at := tmp_path / "d").mkdir()
    shutil.copy(next((tmp_path / "t").glob("*.parquet")), at / "embeddings.parquet")
    got, want = _both(spark, "j21_hamming", at)
    assert len(want) > 1000 and got == want


def test_half_way_values(spark):
    """Counts whose logarithms are to each other as one or three to four lie half-way; their last bit decides."""
    rows = [(m, k, m**p - 1) for m in (7, 14, 48, 49, 176) for k, p in enumerate((1, 3, 4))]
    c = duckdb.connect()
    c.execute("create table h (class integer, cell integer, n bigint)")
    c.executemany("insert into h values (?, ?, ?)", rows)
    sql = catalog.ORACLE["a18_quantise"].replace(catalog._CELLS, "h")
    got = geo.quantised(spark.createDataFrame(rows, "class int, cell int, n long"))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(sql).fetchall())


def test_batches_leave_their_tables_only(spark, tmp_path, monkeypatch):
    rows = [(i, f"{i:04x}", i % 2, f"o{i % 6}", f"o{i % 6}/{i // 12}", f"n{i % 7}" if i % 5 == 0 else None) for i in range(24)]
    links = spark.createDataFrame(rows, "i int, sha string, taxon int, observer string, observation string, near string")
    for module in (storage, curation):
        monkeypatch.setattr(module, "shared_dir", lambda _: str(tmp_path))
    groups, members, held = curation.assignment_batches(spark, links, [F.col("i") < 20, F.col("i") >= 20])
    assert members.read().count() + held.read().count() == 24
    assert {p.name.split("-")[0] for p in tmp_path.iterdir()} == {"table"}


def test_suffix_arrays_sort_ties_only():
    """Copies, cut copies and a run of one byte; also the ends of strings of zeros."""
    assert suffix_array.suffix_array(np.zeros(80, np.uint8), 50).tolist()[:49] == list(range(79, 30, -1))
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 101, rng.integers(50, 160), np.uint8)) for _ in range(1500)]
    parts += [p[3:] for p in parts] + [p[:-3] for p in parts[:500]] + [b"a" * 3000]
    t = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)
    order = suffix_array.suffix_array(t, 50)
    raw = t.tobytes()
    assert sorted(order) == list(range(len(t)))
    assert [raw[i : i + 50] for i in order] == sorted(raw[i : i + 50] for i in range(len(t)))


def test_suffix_array_costs_a_few_sorts():
    t = np.random.default_rng(3).integers(97, 123, 400_000).astype(np.uint8)

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    keys = t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C17)
    assert least(lambda: suffix_array.suffix_array(t, 50)) < 8 * least(lambda: np.argsort(keys, kind="stable"))


def test_ranking_learns_from_all_pairs(spark):
    """The weights are where the loss over every pair of labels 1 and 0 is least, and the cut is exact."""
    rng = np.random.default_rng(7)
    y = (rng.random(260) < 0.4).astype(int)
    f = rng.normal(size=(260, len(quality_ranking.FEATURES))).astype(np.float32)
    f[:, :3] += 0.8 * y[:, None].astype(np.float32)
    taught = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(f, y)], "features array<float>, label int").repartition(3)
    m = quality_ranking.fit(taught)
    f = f.astype(np.float64)
    assert np.allclose(m["mean"], f.mean(0)) and np.allclose(m["std"], f.std(0) + 1e-6)
    x = quality_ranking._expand(f, m["mean"], m["std"])
    d = (x[y == 1][:, None] - x[y == 0][None]).reshape(-1, x.shape[1])
    slope = -(d / (1 + np.exp(d @ m["w"]))[:, None]).mean(0) + quality_ranking.RIDGE * m["w"]
    assert np.abs(slope).max() < 1e-3 and np.abs(d.mean(0)).max() > 0.3
    s, bad = np.sort(x @ m["w"]), int((y == 0).sum())
    assert np.isclose(m["cut"], (s[bad - 1] + s[bad]) / 2)


def test_cut_narrows_to_equal_and_to_close_scores(spark, monkeypatch):
    monkeypatch.setattr(quality_ranking, "LAST", 10)
    k = len(quality_ranking.FEATURES)
    for values in ([0.0] * 50, [1e-9 * i for i in range(60)] + [5.0] * 30, [float(i) for i in range(300)] + [-1e9, 1e9]):
        taught = spark.createDataFrame([([v] * k, 0) for v in values], "features array<float>, label int").repartition(2)
        near = sorted(np.float32(values).astype(np.float64))
        for bad in (1, len(values) // 2, len(values) - 1):
            assert np.isclose(quality_ranking._cut(taught, bad, lambda x: x[:, 0]), (near[bad - 1] + near[bad]) / 2, rtol=1e-6, atol=1e-11)
