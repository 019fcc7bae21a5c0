"""A transfer seen from its two accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def debit_legs(tx: DataFrame) -> DataFrame:
    return tx.select(F.col("from_account").alias("account"), "amount")


def credit_legs(tx: DataFrame) -> DataFrame:
    return tx.select(F.col("to_account").alias("account"), "amount")


def signed_legs(tx: DataFrame, *carry: str) -> DataFrame:
    """Both legs of every transfer from one scan: credit +amount, debit -amount."""
    credit = F.struct(F.col("to_account").alias("account"), F.col("amount").alias("delta"))
    debit = F.struct(F.col("from_account").alias("account"), (-F.col("amount")).alias("delta"))
    return tx.select(*carry, F.explode(F.array(credit, debit)).alias("leg")).select(*carry, "leg.account", "leg.delta")


def two_sided_legs(tx: DataFrame, credit_tick: Column | None = None, debit_tick: Column | None = None) -> DataFrame:
    """Both legs with credit and debit kept apart, and counted.

    The counts tell on which sides an account was seen, so an inner join of credits and
    debits becomes a filter on one aggregate.
    """

    def leg(account: str, tick: Column | None, credit: Column, debit: Column, n_credit: int, n_debit: int) -> Column:
        fields = [] if tick is None else [tick.alias("tick")]
        return F.struct(
            *fields,
            F.col(account).alias("account"),
            credit.alias("credit"),
            debit.alias("debit"),
            F.lit(n_credit).cast("bigint").alias("credit_rows"),
            F.lit(n_debit).cast("bigint").alias("debit_rows"),
        )

    nothing = F.lit(0).cast("bigint")
    amount = F.col("amount")
    credit = leg("to_account", credit_tick, amount, nothing, 1, 0)
    debit = leg("from_account", debit_tick, nothing, amount, 0, 1)
    return tx.select(F.explode(F.array(credit, debit)).alias("leg")).select("leg.*")
