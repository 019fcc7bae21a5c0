"""The views as streaming queries.

Two contracts. Behind a watermark (append mode): a tick is published once, when no row for
it can come any more. Eager (update mode): every micro-batch publishes the new state of
each key it touched. All state is Spark's own, kept in the session's state store.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.functions.legs import two_sided_legs
from tickledger.operators.changelog import SIDES, newest_per_key
from tickledger.schema import micros


def watermarked(tx: DataFrame, delay: timedelta) -> DataFrame:
    return tx.withWatermark("ts", f"{micros(delay)} microseconds")


def _tick_window(granule: str) -> Column:
    return F.window("ts", granule)


def _live_legs(tx: DataFrame, delay: timedelta) -> DataFrame:
    legs = two_sided_legs(tx, F.col("ts"), F.col("ts")).withColumnRenamed("tick", "ts")
    return watermarked(legs, delay)


def account_steps(tx: DataFrame, delay: timedelta, granule: str) -> DataFrame:
    """What each account gained on each side at each closed tick (append).

    `granule` is the resolution of the event times, so one window is one tick. Published
    once, this table is all that the cumulative views need.
    """
    grouped = _live_legs(tx, delay).groupBy(_tick_window(granule).alias("tick"), "account").agg(*[F.sum(c).alias(c) for c in SIDES])
    return grouped.select("account", F.unix_micros("tick.start").alias("tick"), *SIDES)


def net_per_tick(tx: DataFrame, delay: timedelta, granule: str) -> DataFrame:
    """Net change of each account at each closed tick (append)."""
    steps = account_steps(tx, delay, granule)
    return steps.select("tick", "account", (F.col("credit") - F.col("debit")).alias("net"))


def total_per_tick(tx: DataFrame, delay: timedelta, granule: str) -> DataFrame:
    """Sum over accounts of a closed tick's net changes: two chained aggregates (append)."""
    accounts = _live_legs(tx, delay).groupBy(_tick_window(granule).alias("tick"), "account").agg(
        F.sum(F.col("credit") - F.col("debit")).alias("net")
    )
    totals = accounts.groupBy("tick").agg(F.sum("net").alias("total"), F.count(F.lit(1)).alias("accounts"))
    return totals.select(F.unix_micros("tick.start").alias("tick"), "total", "accounts")


def balance_per_tick_by_join(tx: DataFrame, other: DataFrame, delay: timedelta, granule: str) -> DataFrame:
    """Credits joined with debits inside each closed tick (append): two aggregates, one join.

    `tx` and `other` are two readers of the same stream.
    """
    tick = _tick_window(granule).alias("tick")
    credited = watermarked(tx, delay).groupBy(tick, F.col("to_account").alias("account"))
    debited = watermarked(other, delay).groupBy(tick, F.col("from_account").alias("account"))
    joined = credited.agg(F.sum("amount").alias("credits")).join(
        debited.agg(F.sum("amount").alias("debits")), ["tick", "account"]
    )
    return joined.select(
        F.unix_micros("tick.start").alias("tick"), "account", (F.col("credits") - F.col("debits")).alias("balance")
    )


def eager_accounts(tx: DataFrame) -> DataFrame:
    """Running sides of every account touched by a batch (update)."""
    return two_sided_legs(tx).groupBy("account").agg(*[F.sum(c).alias(c) for c in SIDES])


def upserted(tx: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed table: the newest row of every key touched by a batch (update)."""
    return tx.groupBy(F.col(key).alias("__key")).agg(*newest_per_key(tx, order)).drop("__key")


def self_join_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """For every id touched by a batch, whether each input of the left join has it (update)."""
    sides = left.select("id", F.lit(True).alias("l"), F.lit(False).alias("r")).unionByName(
        right.select("id", F.lit(False).alias("l"), F.lit(True).alias("r"))
    )
    return sides.groupBy("id").agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))


def outer_join_with_time(left: DataFrame, right: DataFrame, delay: timedelta) -> DataFrame:
    """Left join on id and event time; a row without a match comes once the watermark passed (append)."""
    t1 = watermarked(left.select("id", "ts"), delay).alias("t1")
    t2 = watermarked(right.select("id", "ts"), delay).alias("t2")
    joined = t1.join(t2, (F.col("t1.id") == F.col("t2.id")) & (F.col("t1.ts") == F.col("t2.ts")), "left")
    return joined.select(F.col("t1.id").alias("id"), F.col("t2.id").alias("other_id"))
