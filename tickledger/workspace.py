"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where `pin` notes what it writes while `pin_alone` makes a table.
_WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (time zone) and let streaming state spill to disk."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local master without one.

    On a cluster a temporary folder would be another disk on each machine, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tickledger-")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/tickledger/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to a parquet table in the shared folder and continue from there.

    Cuts lineage, so a lost executor costs one file read instead of the job above it, and
    gives the planner the exact size: a broadcast is then chosen by the session's threshold.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if (written := _WRITTEN.get()) is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def pin_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """`pin` what `make` gives; the tables that it pins on the way are deleted as soon as that is written.

    Nothing but the result may read those tables later.
    """
    written: list[str] = []
    before = _WRITTEN.set(written)
    try:
        table = pin(make(), label)
    finally:
        _WRITTEN.reset(before)
    *on_the_way, result = written
    for path in on_the_way:
        _delete(spark, path)
    if (outer := _WRITTEN.get()) is not None:
        outer.append(result)
    return table


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query that is run within as soon as it ends.

    Otherwise they stay until the driver happens to collect its garbage, however large they are.
    """
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder by Spark's own file systems, so wherever Spark can write."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
