"""The maintained views as plain DataFrame queries over a transfer table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.functions.legs import credit_legs, debit_legs, signed_legs, two_sided_legs


def accepted_ids(tx: DataFrame) -> DataFrame:
    return tx.select("id")


def credits(tx: DataFrame) -> DataFrame:
    return credit_legs(tx).groupBy("account").agg(F.sum("amount").alias("credits"))


def debits(tx: DataFrame) -> DataFrame:
    return debit_legs(tx).groupBy("account").agg(F.sum("amount").alias("debits"))


def balance(tx: DataFrame) -> DataFrame:
    """credits - debits of the accounts seen on both sides (an inner join on account).

    Written as one aggregate over both legs: one scan and one shuffle of partial sums,
    where joining the two views takes two of each.
    """
    sides = two_sided_legs(tx).groupBy("account").agg(
        F.sum("credit").alias("credits"),
        F.sum("debit").alias("debits"),
        F.sum("credit_rows").alias("credit_rows"),
        F.sum("debit_rows").alias("debit_rows"),
    )
    both = sides.where((F.col("credit_rows") > 0) & (F.col("debit_rows") > 0))
    return both.select("account", (F.col("credits") - F.col("debits")).alias("balance"))


def balance_by_join(credits_view: DataFrame, debits_view: DataFrame) -> DataFrame:
    """The same from two already published views."""
    joined = credits_view.join(debits_view, "account")
    return joined.select("account", (F.col("credits") - F.col("debits")).alias("balance"))


def balance_by_union(tx: DataFrame) -> DataFrame:
    """Net change of every account, one-sided ones included."""
    return signed_legs(tx).groupBy("account").agg(F.sum("delta").alias("balance"))


def total(balances: DataFrame) -> DataFrame:
    """Grand total; one NULL row when there are no balances."""
    return balances.agg(F.sum("balance").alias("total"))


def total_by_constant(balances: DataFrame, constant: str = "foo") -> DataFrame:
    """Grand total under a constant key; no row when there are no balances."""
    return balances.groupBy(F.lit(constant).alias("k")).agg(F.sum("balance").alias("total"))


def sums(tx: DataFrame) -> DataFrame:
    return tx.agg(F.sum("amount").alias("sums"))


def credits_with_time(tx: DataFrame) -> DataFrame:
    grouped = tx.groupBy(F.col("to_account").alias("account"))
    return grouped.agg(F.sum("amount").alias("credits"), F.max("ts").alias("ts"))


def debits_with_time(tx: DataFrame) -> DataFrame:
    grouped = tx.groupBy(F.col("from_account").alias("account"))
    return grouped.agg(F.sum("amount").alias("debits"), F.max("ts").alias("ts"))


def balance_with_time(tx: DataFrame) -> DataFrame:
    """Balances of the accounts whose newest credit and newest debit carry the same time.

    One aggregate instead of the join on (account, ts): max() is NULL on a side never seen,
    and NULL = NULL is not true, so one-sided accounts drop out as they do in the join.
    """
    legs = tx.select(
        F.explode(
            F.array(
                F.struct(F.col("to_account").alias("account"), F.lit(1).alias("side"), "amount", "ts"),
                F.struct(F.col("from_account").alias("account"), F.lit(-1).alias("side"), "amount", "ts"),
            )
        ).alias("leg")
    ).select("leg.*")
    sides = legs.groupBy("account").agg(
        F.sum(F.col("side") * F.col("amount")).alias("balance"),
        F.max(F.when(F.col("side") > 0, F.col("ts"))).alias("credit_ts"),
        F.max(F.when(F.col("side") < 0, F.col("ts"))).alias("debit_ts"),
    )
    return sides.where(F.col("credit_ts") == F.col("debit_ts")).select("account", "balance", F.col("credit_ts").alias("ts"))


def outer_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left id with its match on the right, if there is one."""
    return _left_join(left, right, ["id"])


def outer_join_with_time(left: DataFrame, right: DataFrame) -> DataFrame:
    return _left_join(left, right, ["id", "ts"])


def _left_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    t1, t2 = left.select(*on).alias("t1"), right.select(*on).alias("t2")
    condition = [F.col(f"t1.{c}") == F.col(f"t2.{c}") for c in on]
    return t1.join(t2, condition, "left").select(F.col("t1.id").alias("id"), F.col("t2.id").alias("other_id"))


def net_per_tick(tx: DataFrame) -> DataFrame:
    """Net change of each account at each event time."""
    grouped = signed_legs(tx, "ts").groupBy(F.unix_micros("ts").alias("tick"), "account")
    return grouped.agg(F.sum("delta").alias("net"))


def as_of(tx: DataFrame, ts) -> DataFrame:
    """Transfers visible at logical time `ts`; a column comparison, so the scan can skip files."""
    return tx.where(F.col("ts") <= ts)
