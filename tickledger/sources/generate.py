"""The two transfer data sets, derived row by row from a table of ids.

Both spread their rows evenly over one minute in whole seconds. The random draws are
computed from the id, so a retried task or another partitioning gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.operators.scan import Fold, plan_layout, prefix_scan

# Fixed values of both data sets.
SPAN_SECONDS = 60
ACCOUNTS = 10
MAX_DELAY_MICROS = 10_000_000
START = "2021-01-01 00:00:00"
AMOUNT = 1

PRIME = 2**31 - 1
ROUNDS = 4


def _div(whole: Column, by: Column) -> Column:
    return F.call_function("div", whole, by)


def _second(n: Column) -> Column:
    return _div(F.col("id") * SPAN_SECONDS, n)


def _timestamp(second: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + second)


def simplified(ids: DataFrame, n: Column) -> DataFrame:
    """In-order transfers around a ring: account id % 10 pays the next one."""
    sender = F.col("id") % ACCOUNTS
    return ids.select(
        "id",
        sender.cast("int").alias("from_account"),
        ((sender + 1) % ACCOUNTS).cast("int").alias("to_account"),
        F.lit(AMOUNT).cast("bigint").alias("amount"),
        _timestamp(_second(n)).alias("ts"),
        F.col("id").alias("arrival"),
    )


def _draw(part: int) -> Column:
    """The part-th number drawn for an id, uniform below PRIME: a few rounds of a quadratic map."""
    x = (F.col("id") + (part + 1) * 1_000_003) % PRIME
    for step in range(ROUNDS):
        x = (x * (x + 40_503) + 12_345 * (step + 1)) % PRIME
    return x


def _below(bound: int, part: int) -> Column:
    return _div(_draw(part) * bound, F.lit(PRIME))


def original(ids: DataFrame, n: Column) -> DataFrame:
    """Random transfers, each delayed by up to ten seconds; `arrival` is the resulting position."""
    sent = ids.select(
        "id",
        _below(ACCOUNTS, 0).cast("int").alias("from_account"),
        _below(ACCOUNTS, 1).cast("int").alias("to_account"),
        F.lit(AMOUNT).cast("bigint").alias("amount"),
        _second(n).alias("second"),
    ).select(
        "id",
        "from_account",
        "to_account",
        "amount",
        _timestamp(F.col("second")).alias("ts"),
        (F.col("second") * 1_000_000 + _below(MAX_DELAY_MICROS, 2)).alias("arrives_at"),
        F.lit(1).cast("bigint").alias("one"),
    )
    undelayed = ids.select((F.col("id") * (SPAN_SECONDS * 1e6) / n).cast("bigint").alias("arrives_at"))
    layout = plan_layout(undelayed, "arrives_at")
    placed = prefix_scan(sent, {"position": Fold("sum", "one")}, order=["arrives_at", "id"], layout=layout)
    return placed.select("id", "from_account", "to_account", "amount", "ts", (F.col("position") - 1).alias("arrival"))
