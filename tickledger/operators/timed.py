"""Changelogs of the views that carry event times: credits2, debits2, balance2 and total2.

Their rows hold the newest event time of a side beside its sum, so the scan keeps a running maximum
beside the running sums.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.operators.scan import Fold, Layout, plan_layout, prefix_scan
from tickledger.schema import event_tick
from tickledger.workspace import pin

def _nothing() -> Column:
    return F.lit(0).cast("bigint")



@dataclass(frozen=True)
class TimedSteps:
    """Rows `tick, account, credit, debit, credit_ts, debit_ts`, one per account and tick."""

    rows: DataFrame
    layout: Layout


def _legs(tx: DataFrame, credit_tick: Column, debit_tick: Column) -> DataFrame:
    never = F.lit(None).cast("timestamp")

    def leg(tick: Column, account: str, credit: Column, debit: Column, credit_ts: Column, debit_ts: Column) -> Column:
        return F.struct(tick.alias("tick"), F.col(account).alias("account"), credit.alias("credit"), debit.alias("debit"), credit_ts.alias("credit_ts"), debit_ts.alias("debit_ts"))

    amount, ts = F.col("amount"), F.col("ts")
    both = F.array(leg(credit_tick, "to_account", amount, _nothing(), ts, never), leg(debit_tick, "from_account", _nothing(), amount, never, ts))
    return tx.select(F.explode(both).alias("leg")).select("leg.*")


def event_time_steps(tx: DataFrame) -> TimedSteps:
    """Both sides of every account at each event time, summed before anything is ordered."""
    sums = [F.sum("credit").alias("credit"), F.sum("debit").alias("debit"), F.max("credit_ts").alias("credit_ts"), F.max("debit_ts").alias("debit_ts")]
    rows = pin(_legs(tx, event_tick(), event_tick()).groupBy("account", "tick").agg(*sums), "timed-steps")
    return TimedSteps(rows, plan_layout(rows, "tick", ["account"]))


def eager_steps(tx: DataFrame) -> TimedSteps:
    """The credit of a transfer at 2 * position, its debit right after."""
    rows = _legs(tx, F.col("arrival") * 2, F.col("arrival") * 2 + 1)
    return TimedSteps(rows, plan_layout(rows, "tick", ["account"]))


def _running(steps: TimedSteps) -> DataFrame:
    folds = {f"run_{c}": Fold("sum", c) for c in ("credit", "debit")}
    folds |= {f"run_{c}": Fold("max", c) for c in ("credit_ts", "debit_ts")}
    folds |= {f"old_{c}": Fold("max", c, exclusive=True) for c in ("credit_ts", "debit_ts")}
    return prefix_scan(steps.rows, folds, order=["tick"], keys=["account"], layout=steps.layout, costly=True)


def _replacements(rows: DataFrame, keys: list[str], old: Mapping[str, Column], old_on: Column, new: Mapping[str, Column], new_on: Column) -> DataFrame:
    """The old row leaves (-1) and the new one enters (+1) where any of its values changed."""
    same = F.lit(True)
    for name in old:
        same = same & old[name].eqNullSafe(new[name])
    columns = [F.col("tick"), *[F.col(k) for k in keys]]

    def entry(values: Mapping[str, Column], on: Column, diff: int) -> Column:
        return F.struct(*columns, *[v.alias(n) for n, v in values.items()], F.when(on, F.lit(diff)).alias("diff"))

    changed = rows.where((old_on != new_on) | (old_on & new_on & ~same))
    both = changed.select(F.explode(F.array(entry(old, old_on, -1), entry(new, new_on, 1))).alias("entry"))
    return both.select("entry.*").where("diff is not null")


def _side(steps: TimedSteps, side: str, name: str) -> DataFrame:
    touched = _running(steps).where(F.col(f"{side}_ts").isNotNull())
    old = {name: F.col(f"run_{side}") - F.col(side), "ts": F.col(f"old_{side}_ts")}
    new = {name: F.col(f"run_{side}"), "ts": F.col(f"run_{side}_ts")}
    return _replacements(touched, ["account"], old, F.col(f"old_{side}_ts").isNotNull(), new, F.lit(True))


def credits_changelog(steps: TimedSteps) -> DataFrame:
    return _side(steps, "credit", "credits")


def debits_changelog(steps: TimedSteps) -> DataFrame:
    return _side(steps, "debit", "debits")


def _balances(steps: TimedSteps) -> tuple[DataFrame, dict, Column, dict, Column]:
    """Running rows with the balance before and after each; it exists while both sides' newest times agree."""
    net = F.col("run_credit") - F.col("run_debit")
    old = {"balance": net - F.col("credit") + F.col("debit"), "ts": F.col("old_credit_ts")}
    new = {"balance": net, "ts": F.col("run_credit_ts")}
    old_on = F.coalesce(F.col("old_credit_ts") == F.col("old_debit_ts"), F.lit(False))
    new_on = F.coalesce(F.col("run_credit_ts") == F.col("run_debit_ts"), F.lit(False))
    return _running(steps), old, old_on, new, new_on


def balance_changelog(steps: TimedSteps) -> DataFrame:
    rows, old, old_on, new, new_on = _balances(steps)
    return _replacements(rows, ["account"], old, old_on, new, new_on)


def total_changelog(steps: TimedSteps) -> DataFrame:
    """The sum of all balances with time; without any there is no row."""
    rows, old, old_on, new, new_on = _balances(steps)
    delta = F.when(new_on, new["balance"]).otherwise(_nothing()) - F.when(old_on, old["balance"]).otherwise(_nothing())
    moves = rows.where(old_on | new_on).select("tick", delta.alias("delta"), (new_on.cast("bigint") - old_on.cast("bigint")).alias("accounts"))
    per_tick = moves.groupBy("tick").agg(F.sum("delta").alias("delta"), F.sum("accounts").alias("accounts"))
    scanned = prefix_scan(per_tick, {"total": Fold("sum", "delta"), "run_accounts": Fold("sum", "accounts")}, order=["tick"], layout=steps.layout.unkeyed())
    before = {"total": F.col("total") - F.col("delta")}
    return _replacements(scanned, [], before, F.col("run_accounts") - F.col("accounts") > 0, {"total": F.col("total")}, F.col("run_accounts") > 0)


def accepted_changelog(tx: DataFrame, tick: Column) -> DataFrame:
    """Accepted transfers only ever enter."""
    return tx.select(tick.alias("tick"), "id", F.lit(1).alias("diff"))


def outer_join_with_time_changelog(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on id and event time in event time: both rows of a pair carry one tick, so nothing is taken back."""
    other = right.select(F.col("id").alias("other_id"), F.col("ts").alias("other_ts"))
    joined = left.join(other, (F.col("id") == F.col("other_id")) & (F.col("ts") == F.col("other_ts")), "left")
    return joined.select(event_tick().alias("tick"), "id", "other_id", F.lit(1).alias("diff"))
