"""Shared intermediate tables and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where the session names none, a folder of our own is set, but only on a
    local master; on a cluster a machine-local folder would lose data, so the
    setting is required there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a table that is written takes its shuffle files along: once it is there, nothing reads them any more."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def measured_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within, a side of a join is broadcast by its size as measured in the shuffle, not by that of its files.

    Numbers in a compressed file can be a hundredth of what they are as rows,
    and every broadcast is gathered on the driver.
    """
    static, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (static, adaptive)}
    spark.conf.set(adaptive, before[adaptive] or spark.conf.get(static))
    spark.conf.set(static, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(df: DataFrame, name: str = "stage", *, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table.

    Later jobs read the table and do not recompute its lineage; a lost
    executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", codec).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`staged` wrote and that nothing will read again."""
    for table in tables:
        path = table.__dict__.pop("_staged_at", None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
