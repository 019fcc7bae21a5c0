"""Stored tables as streams, and transfers as a folder of files that streams in arrival order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_FILE = 1_000_000
FILES_PER_BATCH = 64


def write_replay(tx: DataFrame, path: str, batches: int, rows_per_file: int = ROWS_PER_FILE, most_files: int = FILES_PER_BATCH) -> int:
    """Parquet files, each a range of arrival positions, stamped in that order; returns how many make one batch.

    Their number follows the rows, so no task sorts or writes more than about `rows_per_file`. A batch has `most_files`
    at most, so long inputs stream in more than `batches` of them.
    """
    each = max(1, math.ceil(tx.count() / rows_per_file / batches))
    tx.repartitionByRange(each * batches, "arrival").sortWithinPartitions("arrival").write.parquet(path)
    stamp_in_name_order(tx.sparkSession, path)
    return min(each, most_files)


def write_batches(tx: DataFrame, batch: Column, batches: int, path: str, rows_per_file: int = ROWS_PER_FILE) -> int:
    """The same with the rows of each number `batch`, from 0 to `batches` - 1, in files of their own."""
    each = max(1, math.ceil(tx.count() / rows_per_file / batches))
    file_no = batch.cast("int") * each + F.pmod(F.xxhash64("id"), F.lit(each)).cast("int")
    tx.repartitionById(each * batches, file_no).write.parquet(path)
    stamp_in_name_order(tx.sparkSession, path)
    return each


def stamp_in_name_order(spark: SparkSession, path: str) -> list[str]:
    """Give the files of a folder rising modification times by name.

    The file source takes the oldest file first. Only file names pass through here; works
    on file systems that let modification times be set.
    """
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(
        s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith(("_", "."))
    )
    newest = max((fs.getFileStatus(jvm.org.apache.hadoop.fs.Path(folder, n)).getModificationTime() for n in names), default=0)
    for place, name in enumerate(names):
        stamp = newest - 1000 * (len(names) - place)
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(folder, name), stamp, -1)
    return names


def stream_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    files_per_batch: int | None = None,
    name: str | None = None,
) -> DataFrame:
    """A parquet folder as a stream; `name` limits it to the files that match."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name is not None:
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType, *, bytes_per_batch: str | None = None) -> DataFrame:
    """A stored parquet table as a stream, whether it is one file or a folder of part files.

    The file source filters leaf files by name and refuses the path of a single file, so the two forms
    need different paths.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if bytes_per_batch is not None:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    if fs.getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
