import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions import licences, names
from millrace.functions import scalars as S


def test_stable_fraction_matches_sha256(spark):
    keys = [f"k{i}" for i in range(200)] + ["", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", S.stable_fraction(F.col("k"), "s").alias("f"))
    for r in df.collect():
        want = int.from_bytes(hashlib.sha256(b"s\0" + r.k.encode()).digest()[:8], "big") / 2**64
        assert r.f == want


def test_fractions_are_checked():
    for bad in ([("a", 0.5)], [("a", 0.5), ("a", 0.5)], [("a", 1.5), ("b", -0.5)]):
        with pytest.raises(ValueError):
            S.validate_fractions(bad)


@pytest.mark.parametrize(
    "raw, code",
    [
        ("CC BY-NC 4.0", "CC-BY-NC-4.0"),
        ("cc-by", "CC-BY-4.0"),
        ("https://creativecommons.org/licenses/by-sa/2.0/", "CC-BY-SA-2.0"),
        ("Creative Commons Attribution NonCommercial 3.0", "CC-BY-NC-3.0"),
        ("CC0", "CC0-1.0"),
        ("http://creativecommons.org/publicdomain/mark/1.0/", "PDM-1.0"),
        ("All rights reserved", "ARR"),
        ("cc-by-sa-nd", "UNKNOWN"),
        ("cc-nc", "UNKNOWN"),
        ("free to use", "UNKNOWN"),
        (None, "UNKNOWN"),
    ],
)
def test_licences_fail_closed(raw, code):
    assert licences.normalize(raw) == code


def test_licence_join_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "cc-by"), (2, None), (3, "cc-by")], "id int, raw string")
    got = {r.id: r.licence for r in licences.with_licence(df, "raw").collect()}
    assert got == {1: "CC-BY-4.0", 2: "UNKNOWN", 3: "CC-BY-4.0"}


def test_names():
    assert names.parse_name("Salmo trutta Linnaeus, 1758")["authorship"] == "Linnaeus, 1758"
    assert names.parse_name("Salmo cf. trutta")["uncertain"]
    assert names.parse_name("Salmo trutta subsp. fario")["infra"] == "fario"
    assert names.parse_name("Salmo × trutta")["hybrid"]
    assert names.parse_name(None)["genus"] is None


def test_name_udf(spark):
    df = spark.createDataFrame([("Salmo trutta",), (None,)], "n string").select(names.parse_scientific_name("n").alias("p"))
    assert {r.p.epithet for r in df.collect()} == {"trutta", None}


def test_boxes_and_cells(spark):
    df = spark.range(1).select(
        S.expand_box(*[F.lit(float(x)) for x in (0, 0, 10, 10, 1000, 1000)]).alias("b"),
        S.pack_cell(F.lit(90.0), F.lit(180.0), 2.0).alias("c"),
        S.image_flags(F.lit(50), F.lit(400), F.lit(0.5), F.lit(0.0), F.lit(0.5)).alias("f"),
    )
    r = df.first()
    assert (r.b.x, r.b.w) == (0, 224) and r.c == (89 << 16) and r.f == ["tiny", "extreme_aspect"]
