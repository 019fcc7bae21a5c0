"""Checks over published outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.operators.changelog import Steps
from tickledger.operators.scan import Fold, plan_layout, prefix_scan


def output_timeseries(outputs: DataFrame, order: Sequence[str], layout=None) -> DataFrame:
    """Outputs numbered 1, 2, ... in publication order."""
    one = outputs.withColumn("__one", F.lit(1).cast("bigint"))
    layout = layout or plan_layout(one, order[0])
    return prefix_scan(one, {"output_no": Fold("sum", "__one")}, order=order, layout=layout).select("output_no", "total")


def zero_sum(totals: DataFrame) -> DataFrame:
    """How many published totals are not zero, where they start and end, and how far off they are."""
    off = F.col("total") != 0
    return totals.agg(
        F.count(F.lit(1)).alias("outputs"),
        F.count_if(off).alias("nonzero"),
        F.min(F.when(off, F.col("tick"))).alias("first_nonzero"),
        F.max(F.when(off, F.col("tick"))).alias("last_nonzero"),
        F.max(F.abs("total")).alias("max_abs"),
    )


def settled_tick(steps: Steps) -> DataFrame:
    """The first tick at which every account was seen on both sides; NULL if one never is.

    From then on an inner join of credits and debits loses no account, so its total must be 0.
    """
    first = steps.rows.groupBy("account").agg(
        F.greatest(
            F.coalesce(F.min(F.when(F.col("credit_rows") > 0, F.col("tick"))), F.lit(2**63 - 1)),
            F.coalesce(F.min(F.when(F.col("debit_rows") > 0, F.col("tick"))), F.lit(2**63 - 1)),
        ).alias("both")
    )
    last = first.agg(F.max("both").alias("tick"))
    return last.select(F.when(F.col("tick") < 2**63 - 1, F.col("tick")).alias("tick"))


def zero_sum_once_settled(totals: DataFrame, steps: Steps) -> DataFrame:
    """The zero-sum check from the settled tick on. A single row is looked up, so no join."""
    since = settled_tick(steps).scalar()
    return zero_sum(totals.where(F.col("tick") >= since))


def unmatched(self_join: DataFrame) -> DataFrame:
    """Outputs of the self-join that show an id without itself, and how many are left at the end."""
    alone = F.col("other_id").isNull()
    return self_join.agg(
        F.count_if(F.col("diff") > 0).alias("outputs"),
        F.count_if(alone & (F.col("diff") > 0)).alias("unmatched_outputs"),
        F.sum(F.when(alone, F.col("diff")).otherwise(0)).alias("unmatched_at_end"),
    )


def time_alignment(balances: DataFrame, aligned: DataFrame) -> DataFrame:
    """Accounts whose balance mixes a newer side with an older one."""
    marked = balances.join(aligned.select("account", F.lit(1).alias("aligned")), "account", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("accounts"),
        F.count("aligned").alias("aligned"),
        F.count_if(F.col("aligned").isNull()).alias("unaligned"),
        F.sum(F.when(F.col("aligned").isNull(), F.col("balance"))).alias("unaligned_balance"),
    )


def differences(published: DataFrame, expected: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose copies differ between two bags: positive = only published, negative = missing."""
    both = published.select(*columns, F.lit(1).alias("side")).unionByName(expected.select(*columns, F.lit(-1).alias("side")))
    return both.groupBy(*columns).agg(F.sum("side").alias("surplus")).where(F.col("surplus") != 0)


def agreement(entries: DataFrame, views: Sequence[str]) -> DataFrame:
    """Per view, how many rows its history has that the view has not (`surplus`), and the other way round (`missing`).

    `entries` are (view, account, value, diff): the history's own diffs, and -1 for each row of the view.
    """
    left = entries.groupBy("view", "account", "value").agg(F.sum("diff").alias("surplus"))
    named = entries.sparkSession.createDataFrame([(v,) for v in views], "view string")
    found = left.groupBy("view").agg(F.count_if(F.col("surplus") > 0).alias("surplus"), F.count_if(F.col("surplus") < 0).alias("missing"))
    nothing = F.lit(0).cast("bigint")
    return named.join(found, "view", "left").select("view", F.coalesce("surplus", nothing).alias("surplus"), F.coalesce("missing", nothing).alias("missing"))
