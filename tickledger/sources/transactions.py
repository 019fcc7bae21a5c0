"""Reading transfers: JSON lines, keyed lines, raw bytes, keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickledger.schema import TIMESTAMP_FORMAT, WIRE_COLUMNS, WIRE_SCHEMA
from tickledger.workspace import pin

STRICT_JSON = {"mode": "FAILFAST", "timestampFormat": TIMESTAMP_FORMAT}


def complete(df: DataFrame, columns=WIRE_COLUMNS) -> DataFrame:
    """Fail on a missing field: strict JSON parsing alone reads it as NULL."""
    present = F.lit(True)
    for name in columns:
        present = present & F.col(name).isNotNull()
    missing = F.raise_error(F.concat(F.lit("missing field in "), F.to_json(F.struct(*columns)))).cast("boolean")
    return df.where(F.when(present, F.lit(True)).otherwise(missing))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType = WIRE_SCHEMA) -> DataFrame:
    return complete(spark.read.schema(schema).options(**STRICT_JSON).json(path))


def read_numbered_json_lines(spark: SparkSession, path: str, schema: T.StructType = WIRE_SCHEMA) -> DataFrame:
    """The lines with `arrival`, their position from 0 in files by name, and the `file` they stand in.

    Lines are counted per file block, and each block starts where the ones before it end: what is put in order is
    one row per block. The lines themselves are neither moved nor sorted.
    """
    lines = spark.read.schema(schema).options(**STRICT_JSON).json(path).select(
        *schema.fieldNames(),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    blocks = pin(lines.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("line").alias("first")), "line-blocks")
    ahead = F.sum("lines").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1))
    shifts = blocks.select("file", "block", (F.coalesce(ahead, F.lit(0)) - F.col("first")).alias("shift"))
    placed = lines.join(shifts, ["file", "block"])
    return complete(placed.select(*schema.fieldNames(), (F.col("line") + F.col("shift")).alias("arrival"), "file"), schema.fieldNames())


def stream_json_lines(
    spark: SparkSession, path: str, files_per_batch: int | None = None, schema: T.StructType = WIRE_SCHEMA
) -> DataFrame:
    """Files of a growing folder, oldest first; `files_per_batch` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).options(**STRICT_JSON)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return complete(reader.json(path))


def decode_json(messages: DataFrame, value: str = "value", schema: T.StructType = WIRE_SCHEMA) -> DataFrame:
    """UTF-8 bytes or text in `value` to typed transfers; other columns are kept."""
    text = F.col(value)
    if isinstance(messages.schema[value].dataType, T.BinaryType):
        text = F.decode(text, "UTF-8")
    keep = [c for c in messages.columns if c != value]
    parsed = messages.select(*keep, F.from_json(text, schema, STRICT_JSON).alias("record"))
    return complete(parsed.select(*keep, "record.*"), schema.fieldNames())


def json_document(*columns: str) -> Column:
    """The wire form of a transfer."""
    fields = [
        F.date_format(c, TIMESTAMP_FORMAT).alias(c) if c == "ts" else F.col(c) for c in (columns or WIRE_COLUMNS)
    ]
    return F.to_json(F.struct(*fields))


def keyed_lines(tx: DataFrame) -> DataFrame:
    """`id|json` lines."""
    return tx.select(F.concat_ws("|", F.col("id").cast("string"), json_document()).alias("line"))


def split_keyed_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """`id|json` lines back to (key, value); only the first bar separates."""
    parts = F.split(F.col(line), r"\|", 2)
    return lines.select(parts.getItem(0).alias("key"), parts.getItem(1).alias("value"))


def event_time(text: str) -> Column:
    return F.to_timestamp(F.col(text), TIMESTAMP_FORMAT)
