"""Writing views and changelogs out, and reading them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str) -> None:
    """Rendered lines as text files, in tick order across the files.

    The rows are range-partitioned by tick and sorted inside each file: reading the files
    by name gives the order back, and no single task writes everything.
    """
    ordered = lines.orderBy("tick", "diff", "line") if "tick" in lines.columns else lines
    ordered.select("line").write.text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("line"))


def write_messages(messages: DataFrame, path: str) -> None:
    messages.write.parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A published view from the beginning."""
    return spark.read.parquet(path)
