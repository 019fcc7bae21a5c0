"""Changelogs: a view's history as rows (tick, *columns, diff) with diff -1 or +1.

`tick` is the only thing that changes between the consistency contracts: event time makes
all views agree at every tick, the input position shows every intermediate state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickledger.functions.legs import two_sided_legs
from tickledger.operators.scan import Fold, Layout, plan_layout, prefix_scan
from tickledger.schema import event_tick
from tickledger.workspace import pin

SIDES = ("credit", "debit", "credit_rows", "debit_rows")
COPIES_PER_STEP = 1_000_000


# ---------------------------------------------------------------- account steps by tick


@dataclass(frozen=True)
class Steps:
    """Rows (account, tick, *SIDES), one per account and tick, and how to scan them.

    `per_tick` is the most rows one tick can have, where that is known: with one there is
    nothing to add up per tick, with two it does not pay to do so before a shuffle. `scanned`
    holds the running sides where several views share one scan (`scanned_once`).
    """

    rows: DataFrame
    layout: Layout
    per_tick: int | None = None
    scanned: DataFrame | None = None

    def running(self, rows: DataFrame, columns: Sequence[str]) -> DataFrame:
        """`rows` with the running value of `columns` per account, as run_<column>."""
        folds = {f"run_{c}": Fold("sum", c) for c in columns}
        return prefix_scan(rows, folds, keys=["account"], order=["tick"], layout=self.layout)

    def running_side(self, side: str) -> DataFrame:
        if self.scanned is not None:
            columns = [side, f"{side}_rows", f"run_{side}", f"run_{side}_rows"]
            return self.scanned.where(F.col(f"{side}_rows") > 0).select("account", "tick", *columns)
        rows = self.rows.where(F.col(f"{side}_rows") > 0).select("account", "tick", side, f"{side}_rows")
        return self.running(rows, [side, f"{side}_rows"])

    def running_balance(self) -> DataFrame:
        net = (F.col("credit") - F.col("debit")).alias("net")
        if self.scanned is not None:
            run_net = (F.col("run_credit") - F.col("run_debit")).alias("run_net")
            return self.scanned.select("account", "tick", net, "credit_rows", "debit_rows", run_net, "run_credit_rows", "run_debit_rows")
        return self.running(
            self.rows.select("account", "tick", net, "credit_rows", "debit_rows"), ["net", "credit_rows", "debit_rows"]
        )


def scanned_once(steps: Steps) -> Steps:
    """The same steps with all four sides scanned once and written, for several views that follow from them."""
    return replace(steps, scanned=pin(steps.running(steps.rows, SIDES), "running-sides"))


def event_time_steps(tx: DataFrame) -> Steps:
    """What each account gained on each side at each event time.

    Pre-aggregated to one row per (account, tick) before anything is ordered.
    """
    ticks = two_sided_legs(tx, event_tick(), event_tick())
    steps = pin(ticks.groupBy("account", "tick").agg(*[F.sum(c).alias(c) for c in SIDES]), "account-steps")
    return Steps(steps, plan_layout(steps, "tick", ["account"]))


def arrival_steps(tx: DataFrame) -> Steps:
    """Both legs of a transfer at its input position, one row per (account, position)."""
    amount, one, nothing = F.col("amount"), F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def leg(account: str, credit: Column, debit: Column, n_credit: Column, n_debit: Column) -> Column:
        return F.struct(
            F.col("arrival").alias("tick"),
            F.col(account).alias("account"),
            credit.alias("credit"),
            debit.alias("debit"),
            n_credit.alias("credit_rows"),
            n_debit.alias("debit_rows"),
        )

    within = F.array(leg("to_account", amount, amount, one, one))
    between = F.array(
        leg("to_account", amount, nothing, one, nothing), leg("from_account", nothing, amount, nothing, one)
    )
    same = F.col("from_account") == F.col("to_account")
    steps = tx.select(F.explode(F.when(same, within).otherwise(between)).alias("leg")).select("leg.*")
    return Steps(steps, plan_layout(steps, "tick", ["account"]), per_tick=2)


def eager_steps(tx: DataFrame) -> Steps:
    """The two legs of a transfer at two ticks: credit at 2*position, debit right after."""
    credit_tick = F.col("arrival") * 2
    steps = two_sided_legs(tx, credit_tick, credit_tick + 1)
    return Steps(steps, plan_layout(steps, "tick", ["account"]), per_tick=1)


# ---------------------------------------------------------------- views over account steps


def _entries(rows: DataFrame, keys: Sequence[str], value: str, old: Column, old_on: Column, new: Column, new_on: Column):
    """Replacement entries: the old row leaves (-1) and the new one enters (+1) where it changed."""
    columns = [F.col("tick"), *[F.col(k) for k in keys]]
    changed = (old_on != new_on) | (old_on & new_on & ~old.eqNullSafe(new))
    out = F.struct(*columns, old.alias(value), F.when(old_on, F.lit(-1)).alias("diff"))
    entered = F.struct(*columns, new.alias(value), F.when(new_on, F.lit(1)).alias("diff"))
    both = rows.where(changed).select(F.explode(F.array(out, entered)).alias("entry")).select("entry.*")
    return both.where(F.col("diff").isNotNull())


def _before(column: str) -> Column:
    return F.col(f"run_{column}") - F.col(column)


def side_changelog(steps: Steps, side: str, name: str) -> DataFrame:
    """`credits` or `debits`: the running sum of one side."""
    return _entries(
        steps.running_side(side),
        ["account"],
        name,
        _before(side),
        _before(f"{side}_rows") > 0,
        F.col(f"run_{side}"),
        F.col(f"run_{side}_rows") > 0,
    )


def credits_changelog(steps: Steps) -> DataFrame:
    return side_changelog(steps, "credit", "credits")


def debits_changelog(steps: Steps) -> DataFrame:
    return side_changelog(steps, "debit", "debits")


def _balance_state() -> tuple[Column, Column, Column, Column]:
    old_on = (_before("credit_rows") > 0) & (_before("debit_rows") > 0)
    new_on = (F.col("run_credit_rows") > 0) & (F.col("run_debit_rows") > 0)
    return _before("net"), old_on, F.col("run_net"), new_on


def balance_changelog(steps: Steps) -> DataFrame:
    """credits - debits; an account enters once it was seen on both sides."""
    old, old_on, new, new_on = _balance_state()
    return _entries(steps.running_balance(), ["account"], "balance", old, old_on, new, new_on)


def balance_moves(steps: Steps) -> DataFrame:
    """How a changed balance moves the grand total and the number of balances: (tick, delta, accounts)."""
    old, old_on, new, new_on = _balance_state()
    nothing = F.lit(0).cast("bigint")
    changed = (old_on != new_on) | (new_on & (old != new))
    return steps.running_balance().where(changed).select(
        "tick",
        (F.when(new_on, new).otherwise(nothing) - F.when(old_on, old).otherwise(nothing)).alias("delta"),
        (new_on.cast("bigint") - old_on.cast("bigint")).alias("accounts"),
    )


def _running_per_tick(steps: Steps, moves: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Moves added up per tick, and the running sums of `columns` (name -> column)."""
    sums = {c: F.sum(c) for c in columns.values()}
    folds = {name: Fold("sum", c) for name, c in columns.items()}
    layout = steps.layout.unkeyed()
    if steps.per_tick == 1:
        return prefix_scan(moves, folds, order=["tick"], layout=layout, costly=True)
    if steps.per_tick == 2:
        return prefix_scan(moves, folds, order=["tick"], layout=layout, combine=sums)
    per_tick = moves.groupBy("tick").agg(*[total.alias(c) for c, total in sums.items()])
    return prefix_scan(per_tick, folds, order=["tick"], layout=layout)


def running_total(deltas: DataFrame, layout: Layout | None = None) -> DataFrame:
    """Cumulative sum of one `delta` per tick, over all ticks."""
    layout = layout or plan_layout(deltas, "tick")
    return prefix_scan(deltas, {"total": Fold("sum", "delta")}, order=["tick"], layout=layout)


def total_by_tick(steps: Steps, rest: int = 0) -> DataFrame:
    """The grand total after every tick that changed a balance: (tick, total). `rest` is the sum of balances not in `steps`."""
    return _running_per_tick(steps, balance_moves(steps), {"total": "delta"}).select("tick", (F.col("total") + rest).alias("total") if rest else "total")


def total_changelog(steps: Steps, rest: tuple[int, int] = (0, 0)) -> DataFrame:
    """The grand total as a changelog; a tick that leaves it as it was writes nothing.

    `rest` is the sum and the number of balances that are not in `steps`.
    """
    scanned = _running_per_tick(steps, balance_moves(steps), {"total": "delta", "run_accounts": "accounts"})
    if rest != (0, 0):
        scanned = scanned.withColumns({"total": F.col("total") + rest[0], "run_accounts": F.col("run_accounts") + rest[1]})
    old_on = (F.col("run_accounts") - F.col("accounts")) > 0
    return _entries(
        scanned, [], "total", F.col("total") - F.col("delta"), old_on, F.col("total"), F.col("run_accounts") > 0
    )


def union_total_by_tick(steps: Steps) -> DataFrame:
    """The grand total over every account, one-sided ones included."""
    moves = steps.rows.select("tick", (F.col("credit") - F.col("debit")).alias("delta"))
    return _running_per_tick(steps, moves, {"total": "delta"}).select("tick", "total")


def self_join_changelog(tx: DataFrame, on: Sequence[str] = ("id",)) -> DataFrame:
    """Left self-join on id (and what else `on` names), fed eagerly: the left input at 2*position, the right one after.

    Each id first appears unmatched, then that row is taken back for the matched one. Ids are unique, so
    no key can be hot and none is looked for.
    """

    def entries(tick: Column) -> DataFrame:
        return tx.select(tick.alias("tick"), F.struct(*on).alias("key"), F.col("id").alias("value"), F.lit(1).alias("diff"))

    position, layout = F.col("arrival") * 2, Layout("tick", ("key",))
    joined = join_changelogs(
        entries(position), entries(position + 1), "key", "value", "value", lambda _, other: other, "other_id", how="left", layout=layout
    )
    return joined.select("tick", F.col("key.id").alias("id"), "other_id", "diff")


# ---------------------------------------------------------------- algebra on changelogs


def consolidate(changelog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add up the diffs of equal rows at equal ticks; what cancels out disappears."""
    summed = changelog.groupBy("tick", *columns).agg(F.sum("diff").alias("diff"))
    return summed.where(F.col("diff") != 0)


def weighted_sum(changelog: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """sum(value * diff) per key; a key goes away with its last copy."""
    grouped = changelog.groupBy(key).agg(
        F.sum(F.col(value) * F.col("diff")).alias(name), F.sum("diff").alias("copies")
    )
    return grouped.where(F.col("copies") > 0).select(key, name)


def snapshot_as_of(changelog: DataFrame, columns: Sequence[str], tick) -> DataFrame:
    """The view's rows at a tick, with how many copies of each there are."""
    at = changelog.where(F.col("tick") <= tick).groupBy(*columns).agg(F.sum("diff").alias("copies"))
    return at.where(F.col("copies") > 0)


def repeat_copies(rows: DataFrame, columns: Sequence[str], step: int = COPIES_PER_STEP) -> DataFrame:
    """A bag written out row by row.

    Each count is first cut into steps that are spread over the cluster, so one row with a
    huge count neither builds one huge array nor fills one task.
    """
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1, F.lit(step).cast("bigint")))
    cut = rows.withColumn("start", starts).withColumn("take", F.least(F.lit(step), F.col("copies") - F.col("start")))
    spread = cut.repartition(*columns, "start")
    copy = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("take").cast("bigint")))
    return spread.withColumn("copy", copy).select(*columns)


def history(changelog: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Everything from tick 0 in publication order: deletes before inserts within a tick."""
    return changelog.select("tick", *columns, "diff").orderBy("tick", "diff", *columns)


# ---------------------------------------------------------------- keyed tables


def retractions(upserts: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Upserts as a changelog of the latest row per key.

    The replaced row is the last one seen before; a later upsert with equal content writes
    nothing new to the view but still replaces, so both entries are kept.
    """
    rows = upserts.select(F.col(key), F.col(order).alias("tick"), *columns).withColumn("row", F.struct(*columns))
    layout = plan_layout(rows, "tick", [key])
    scanned = prefix_scan(
        rows, {"old": Fold("last", "row", exclusive=True)}, keys=[key], order=["tick"], layout=layout
    )
    entry = F.explode(
        F.array(
            F.struct(F.col("old").alias("row"), F.when(F.col("old").isNotNull(), F.lit(-1)).alias("diff")),
            F.struct(F.col("row"), F.lit(1).alias("diff")),
        )
    )
    entries = scanned.select("tick", F.col(key), entry.alias("entry")).where(F.col("entry.diff").isNotNull())
    return entries.select("tick", key, "entry.row.*", "entry.diff")


def newest_per_key(upserts: DataFrame, order: str) -> list[Column]:
    """Each column of the row with the highest `order`; fixed-size columns aggregate by hash."""
    return [F.max_by(c, order).alias(c) for c in upserts.columns]


def latest(upserts: DataFrame, key: str, order: str) -> DataFrame:
    """Keyed table: the last upsert of each key. Maxima are taken before the shuffle."""
    return upserts.groupBy(F.col(key).alias("__key")).agg(*newest_per_key(upserts, order)).drop("__key")


def changelog_of_versions(versions: DataFrame, keys: Sequence[str], value: str, live: Column, tick: str = "tick") -> DataFrame:
    """Published states (keys, value, tick), one per key and tick, as a changelog.

    `live` tells whether the state is a row of the view at all.
    """
    rows = versions.select(*keys, F.col(tick).alias("tick"), F.struct(live.alias("on"), F.col(value)).alias("state"))
    layout = plan_layout(rows, "tick", keys)
    scanned = prefix_scan(
        rows, {"old": Fold("last", "state", exclusive=True)}, keys=keys, order=["tick"], layout=layout
    )
    old_on = F.coalesce(F.col("old.on"), F.lit(False))
    return _entries(scanned, keys, value, F.col(f"old.{value}"), old_on, F.col(f"state.{value}"), F.col("state.on"))


# ---------------------------------------------------------------- join of two changelogs


def join_changelogs(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_value: str,
    right_value: str,
    combine: Callable[[Column, Column], Column],
    name: str,
    *,
    how: str = "inner",
    layout: Layout | None = None,
) -> DataFrame:
    """Join of two keyed views from their changelogs to the changelog of the result.

    Each view holds at most one row per key at a time (both are grouped by it), so at any
    tick the join depends on the current row of either side. One ordered sweep per key
    carries those along: work is linear in the entries, where matching validity intervals
    pairwise is quadratic for a key that changes often. With `how="left"` a left row
    without a match is kept, its right value NULL.
    """

    def side(changelog: DataFrame, value: str, mark: str) -> DataFrame:
        return changelog.select(key, "tick", F.col(value).alias(f"{mark}_value"), F.col("diff").alias(f"{mark}_diff"))

    entries = side(left, left_value, "l").unionByName(side(right, right_value, "r"), allowMissingColumns=True)
    layout = layout or plan_layout(entries, "tick", [key])
    # Per tick, the row a side ends up with, or on = False when its row was only deleted.
    after, folds = {}, {}
    for mark in ("l", "r"):
        entered = F.col(f"{mark}_diff") > 0
        value, on = F.max(F.when(entered, F.col(f"{mark}_value"))), F.max(entered)
        after[mark] = F.when(on.isNotNull(), F.struct(on.alias("on"), value.alias("value")))
        folds[f"{mark}_old"] = Fold("last", mark, exclusive=True)
    swept = prefix_scan(entries, folds, keys=[key], order=["tick"], layout=layout, combine=after)
    swept = swept.withColumns({f"{mark}_new": F.coalesce(mark, f"{mark}_old") for mark in ("l", "r")})

    def state(age: str) -> tuple[Column, Column]:
        l_on, r_on = (F.coalesce(F.col(f"{mark}_{age}.on"), F.lit(False)) for mark in ("l", "r"))
        other = F.when(r_on, F.col(f"r_{age}.value"))
        return combine(F.col(f"l_{age}.value"), other), l_on if how == "left" else l_on & r_on

    old, old_on = state("old")
    new, new_on = state("new")
    return _entries(swept, [key], name, old, old_on, new, new_on)
