"""Transfer ledgers derived from stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPSERT_KEYS = 500


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ledger_from_events(events: DataFrame) -> DataFrame:
    """Ten busy accounts, hourly event times, input positions out of time order."""
    step = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 10).cast("int").alias("from_account"),
        ((F.col("user_id") + step) % 10).cast("int").alias("to_account"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
        (F.col("event_id") + (F.col("event_id") * 7919) % 211).alias("arrival"),
    )


def ledger_from_orders(orders: DataFrame) -> DataFrame:
    """Many accounts, part of them on one side only."""
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").cast("int").alias("from_account"),
        ((F.col("o_custkey") * 31 + F.col("o_orderkey")) % 1600).cast("int").alias("to_account"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("arrival"),
    )


def upserts_from_events(events: DataFrame) -> DataFrame:
    """The event ledger as updates of a keyed table: a later row replaces the earlier one."""
    return ledger_from_events(events).withColumn("key", F.col("id") % UPSERT_KEYS)
