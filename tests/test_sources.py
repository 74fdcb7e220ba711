import gzip
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources import readers, sinks
from millrace.streaming.incremental import append_stream

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])


def test_tsv_gz(spark, tmp_path):
    with gzip.open(tmp_path / "a.tsv.gz", "wt") as f:
        f.write('id\tname\n1\ta "quoted\n2\t\\N\n')
    df = readers.tsv(spark, str(tmp_path / "a.tsv.gz"), SCHEMA, null="\\N", parts=2)
    assert sorted(map(tuple, df.collect())) == [(1, 'a "quoted'), (2, None)]


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("id\tname\nx\ty\n")
    with pytest.raises(Exception):
        readers.tsv(spark, str(tmp_path / "b.tsv"), SCHEMA).collect()


def test_append_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], SCHEMA)
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"), ["id"], [F.col("name")])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).collect())) == [(1, "a"), (2, None)]


def test_partitions_are_replaced_one_by_one(spark, tmp_path):
    p = str(tmp_path / "p")
    sinks.replace_partition(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA), p, "name")
    sinks.replace_partition(spark.createDataFrame([(3, "a")], SCHEMA), p, "name")
    assert sorted((r.id, r.name) for r in spark.read.parquet(p).collect()) == [(2, "b"), (3, "a")]


def test_stream_appends_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA).write.parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        q = append_stream(stream, out, ["id"], ["name"], str(tmp_path / f"cp{time.time_ns()}"))
        q.awaitTermination(60)
    assert spark.read.parquet(out).count() == 2
