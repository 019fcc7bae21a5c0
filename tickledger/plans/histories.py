"""Changelogs of the views, and what can be done with them."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tickledger.functions import render
from tickledger.operators import audit
from tickledger.operators import changelog as C
from tickledger.operators import timed as T
from tickledger.plans.inputs import (
    ARRIVAL_TICKS,
    BALANCE2_LOG,
    BALANCE_LOG,
    CREDITS2_LOG,
    CREDITS_LOG,
    DEBITS2_LOG,
    DEBITS_LOG,
    EAGER_TICKS,
    EVENT_TICKS,
    KEPT,
    MARKED,
    ORDER_TX,
    RUNS,
    SELF_JOIN_LOG,
    TOTAL2_LOG,
    TOTAL_LOG,
    TOTALS,
    TX,
    UPSERTS,
    kept_transfers,
    legs,
    order_transfers,
    sql,
    timed_runs,
    transfers,
    upserts,
)
from tickledger.plans.registry import plan
from tickledger.schema import event_tick
from tickledger.sinks import publish
from tickledger.sinks.snapshots import SnapshotIndex
from tickledger.workspace import fresh_path

SNAPSHOT_AT = 1_705_363_200_000_000
assert SNAPSHOT_AT == int(datetime(2024, 1, 16, tzinfo=timezone.utc).timestamp()) * 1_000_000

SNAPSHOT_RUNS = 8

KEPT_RUNS = (TX, MARKED, KEPT, legs("kept", *EVENT_TICKS), RUNS)
FULL_RUNS = (TX, legs("tx", *EVENT_TICKS), RUNS)
EAGER_RUNS = (TX, legs("tx", *EAGER_TICKS), RUNS)
ARRIVAL_RUNS = (TX, legs("tx", *ARRIVAL_TICKS), RUNS)
ORDER_RUNS = (ORDER_TX, legs("tx", *EVENT_TICKS), RUNS)

# Every ledger under every contract: (name suffix, steps, SQL of the running sides).
CONTRACTS = [
    ("", lambda s, f: C.event_time_steps(kept_transfers(s, f)), KEPT_RUNS),
    ("_full", lambda s, f: C.event_time_steps(transfers(s, f)), FULL_RUNS),
    ("_by_arrival", lambda s, f: C.arrival_steps(transfers(s, f)), ARRIVAL_RUNS),
    ("_eager", lambda s, f: C.eager_steps(transfers(s, f)), EAGER_RUNS),
    ("_orders", lambda s, f: C.event_time_steps(order_transfers(s, f)), ORDER_RUNS),
]
# Every view: (name, changelog, SQL of the log, its columns).
HISTORIES = [
    ("credits_changelog", C.credits_changelog, (CREDITS_LOG,), "SELECT tick, account, credits, diff FROM credits_log"),
    ("debits_changelog", C.debits_changelog, (DEBITS_LOG,), "SELECT tick, account, debits, diff FROM debits_log"),
    ("balance_changelog", C.balance_changelog, (BALANCE_LOG,), "SELECT tick, account, balance, diff FROM balance_log"),
    ("total_changelog", C.total_changelog, (BALANCE_LOG, TOTALS, TOTAL_LOG), "SELECT tick, total, diff FROM total_log"),
    ("total_by_tick", C.total_by_tick, (BALANCE_LOG, TOTALS), "SELECT tick, total FROM totals"),
]


def _register(view, changelog, log, out, suffix, steps, runs):
    @plan(f"{view}{suffix}", sql(*runs, *log, out))
    def history(spark, folder):
        return changelog(steps(spark, folder))


for _suffix, _steps, _runs in CONTRACTS:
    for _view, _changelog, _log, _out in HISTORIES:
        _register(_view, _changelog, _log, _out, _suffix, _steps, _runs)


TIMED_CONTRACTS = [
    ("", lambda s, f: T.event_time_steps(kept_transfers(s, f)), (TX, MARKED, KEPT, *timed_runs("kept", *EVENT_TICKS))),
    ("_eager", lambda s, f: T.eager_steps(transfers(s, f)), (TX, *timed_runs("tx", *EAGER_TICKS))),
]
TIMED_HISTORIES = [
    ("credits2_changelog", T.credits_changelog, (CREDITS2_LOG,), "SELECT tick, account, credits, ts, diff FROM credits2_log"),
    ("debits2_changelog", T.debits_changelog, (DEBITS2_LOG,), "SELECT tick, account, debits, ts, diff FROM debits2_log"),
    ("balance2_changelog", T.balance_changelog, (BALANCE2_LOG,), "SELECT tick, account, balance, ts, diff FROM balance2_log"),
    ("total2_changelog", T.total_changelog, (BALANCE2_LOG, TOTAL2_LOG), "SELECT tick, total, diff FROM total2_log"),
]
for _suffix, _steps, _runs in TIMED_CONTRACTS:
    for _view, _changelog, _log, _out in TIMED_HISTORIES:
        _register(_view, _changelog, _log, _out, _suffix, _steps, _runs)


@plan("accepted_transactions_changelog", sql(TX, MARKED, KEPT, "SELECT epoch_us(ts) AS tick, id, 1 AS diff FROM kept"))
def accepted_transactions_changelog(spark, folder):
    return T.accepted_changelog(kept_transfers(spark, folder), event_tick())


@plan("accepted_transactions_changelog_eager", sql(TX, "SELECT 2 * arrival AS tick, id, 1 AS diff FROM tx"))
def accepted_transactions_changelog_eager(spark, folder):
    return T.accepted_changelog(transfers(spark, folder), F.col("arrival") * 2)


@plan(
    "outer_join_with_time_changelog",
    sql(
        TX,
        MARKED,
        KEPT,
        """SELECT epoch_us(t1.ts) AS tick, t1.id, t2.id AS other_id, 1 AS diff
FROM kept AS t1 LEFT JOIN kept AS t2 ON t1.id = t2.id AND t1.ts = t2.ts""",
    ),
)
def outer_join_with_time_changelog(spark, folder):
    kept = kept_transfers(spark, folder)
    return T.outer_join_with_time_changelog(kept.select("id", "ts"), kept.select("id", "ts"))


@plan("outer_join_with_time_changelog_eager", sql(TX, SELF_JOIN_LOG, "SELECT tick, id, other_id, diff FROM self_join_log"))
def outer_join_with_time_changelog_eager(spark, folder):
    """Ids are unique, so the condition on event time holds for the pairs that ids make."""
    return C.self_join_changelog(transfers(spark, folder), on=("id", "ts"))


def _kept_steps(spark, folder) -> C.Steps:
    return C.event_time_steps(kept_transfers(spark, folder))


def _kept_balances(spark, folder):
    return C.balance_changelog(_kept_steps(spark, folder))


UNION_TOTALS = """SELECT tick, CAST(sum(sum(c - d)) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
FROM legs GROUP BY tick"""


@plan("union_total_by_tick", sql(TX, MARKED, KEPT, legs("kept", *EVENT_TICKS), UNION_TOTALS))
def union_total_by_tick(spark, folder):
    return C.union_total_by_tick(_kept_steps(spark, folder))


@plan("union_total_by_tick_eager", sql(TX, legs("tx", *EAGER_TICKS), UNION_TOTALS))
def union_total_by_tick_eager(spark, folder):
    return C.union_total_by_tick(C.eager_steps(transfers(spark, folder)))


@plan("outer_join_changelog_eager", sql(TX, SELF_JOIN_LOG, "SELECT tick, id, other_id, diff FROM self_join_log"))
def outer_join_changelog_eager(spark, folder):
    return C.self_join_changelog(transfers(spark, folder))


@plan("join_changelogs", sql(*KEPT_RUNS, BALANCE_LOG, "SELECT tick, account, balance, diff FROM balance_log"))
def join_changelogs(spark, folder):
    """The balance history from the published credit and debit histories alone."""
    steps = C.scanned_once(_kept_steps(spark, folder))
    return C.join_changelogs(
        C.credits_changelog(steps),
        C.debits_changelog(steps),
        "account",
        "credits",
        "debits",
        lambda credits, debits: credits - debits,
        "balance",
        layout=steps.layout,
    )


@plan(
    "consolidate",
    sql(
        *KEPT_RUNS,
        CREDITS_LOG,
        DEBITS_LOG,
        "entries AS (SELECT tick, account, diff FROM credits_log UNION ALL SELECT tick, account, diff FROM debits_log)",
        "SELECT tick, account, CAST(sum(diff) AS BIGINT) AS diff FROM entries GROUP BY tick, account HAVING sum(diff) <> 0",
    ),
)
def consolidate(spark, folder):
    """Which accounts a side gained at a tick: replacements cancel out."""
    steps = C.scanned_once(_kept_steps(spark, folder))
    entries = [log(steps).select("tick", "account", "diff") for log in (C.credits_changelog, C.debits_changelog)]
    return C.consolidate(entries[0].unionByName(entries[1]), ["account"])


@plan(
    "weighted_sum",
    sql(
        *KEPT_RUNS,
        BALANCE_LOG,
        """SELECT account, CAST(sum(balance * diff) AS BIGINT) AS balance FROM balance_log
GROUP BY account HAVING sum(diff) > 0""",
    ),
)
def weighted_sum(spark, folder):
    return C.weighted_sum(_kept_balances(spark, folder), "account", "balance", "balance")


RETRACTIONS = """replaced AS (
  SELECT *, lag(to_account) OVER w AS old_account, lag(amount) OVER w AS old_amount
  FROM upserts WINDOW w AS (PARTITION BY key ORDER BY arrival, id)),
retractions AS (
  SELECT arrival AS tick, key, old_account AS to_account, old_amount AS amount, -1 AS diff FROM replaced
  WHERE old_account IS NOT NULL
  UNION ALL SELECT arrival, key, to_account, amount, 1 FROM replaced)"""


@plan("retractions", sql(TX, UPSERTS, RETRACTIONS, "SELECT tick, key, to_account, amount, diff FROM retractions"))
def retractions(spark, folder):
    return C.retractions(upserts(spark, folder), "key", "arrival", ["to_account", "amount"])


@plan(
    "retractable_sum",
    sql(
        TX,
        UPSERTS,
        "newest AS (SELECT * FROM upserts QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC, id DESC) = 1)",
        "SELECT to_account, CAST(sum(amount) AS BIGINT) AS credits FROM newest GROUP BY to_account",
    ),
)
def retractable_sum(spark, folder):
    """Credits of a keyed table: what an update replaces is subtracted again."""
    changes = C.retractions(upserts(spark, folder), "key", "arrival", ["to_account", "amount"])
    return C.weighted_sum(changes, "to_account", "amount", "credits")


@plan(
    "retractable_total",
    sql(
        TX,
        UPSERTS,
        RETRACTIONS,
        """SELECT tick, CAST(sum(sum(amount * diff)) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
FROM retractions GROUP BY tick""",
    ),
)
def retractable_total(spark, folder):
    """The global sum of a keyed table after every update."""
    rows = upserts(spark, folder)
    changes = C.retractions(rows, "key", "arrival", ["to_account", "amount"])
    per_tick = changes.groupBy("tick").agg(F.sum(F.col("amount") * F.col("diff")).alias("delta"))
    layout = C.plan_layout(rows.select(F.col("arrival").alias("tick")), "tick")
    return C.running_total(per_tick, layout).select("tick", "total")


SNAPSHOT = f"""SELECT account, balance, CAST(sum(diff) AS BIGINT) AS copies FROM balance_log
WHERE tick <= {SNAPSHOT_AT} GROUP BY account, balance HAVING sum(diff) > 0"""


@plan("snapshot_as_of", sql(*KEPT_RUNS, BALANCE_LOG, SNAPSHOT))
def snapshot_as_of(spark, folder):
    return C.snapshot_as_of(_kept_balances(spark, folder), ["account", "balance"], SNAPSHOT_AT)


@plan(
    "snapshot_bag",
    sql(TX, "SELECT to_account, from_account FROM tx WHERE ts <= TIMESTAMP '2024-01-16 00:00:00'"),
)
def snapshot_bag(spark, folder):
    """A bag with many equal rows, counted at a tick and written out again."""
    pairs = transfers(spark, folder).select(
        F.unix_micros("ts").alias("tick"), "to_account", "from_account", F.lit(1).alias("diff")
    )
    columns = ["to_account", "from_account"]
    return C.repeat_copies(C.snapshot_as_of(pairs, columns, SNAPSHOT_AT), columns)


@plan("snapshot_from_index", sql(*KEPT_RUNS, BALANCE_LOG, SNAPSHOT))
def snapshot_from_index(spark, folder):
    """The view at a tick from one snapshot and the runs after it."""
    log = _kept_balances(spark, folder).select("tick", "account", "balance", F.col("diff").cast("long").alias("diff"))
    index = SnapshotIndex(spark, fresh_path(spark, "snapshot-index"), log.schema, least_rows=5_000)
    index.append(0, log, runs=SNAPSHOT_RUNS)
    return index.as_of(SNAPSHOT_AT)


@plan("changes_from_index", sql(*KEPT_RUNS, BALANCE_LOG, f"SELECT tick, account, balance, diff FROM balance_log WHERE tick > {SNAPSHOT_AT}"))
def changes_from_index(spark, folder):
    """What happened after a tick, from the runs that hold later ticks."""
    log = _kept_balances(spark, folder).select("tick", "account", "balance", F.col("diff").cast("long").alias("diff"))
    index = SnapshotIndex(spark, fresh_path(spark, "snapshot-index"), log.schema)
    last = index.append(0, log, runs=SNAPSHOT_RUNS).runs
    return index.changes(SNAPSHOT_AT, last[-1].last if last else SNAPSHOT_AT)


@plan("tail_as_of_zero", sql(*KEPT_RUNS, BALANCE_LOG, "SELECT tick, account, balance, diff FROM balance_log ORDER BY 1, 4, 2, 3"))
def tail_as_of_zero(spark, folder):
    return C.history(_kept_balances(spark, folder), ["account", "balance"])


RETRACT_LINES = """lines AS (
  SELECT tick, diff, CASE WHEN diff > 0 THEN 'insert ' ELSE 'delete ' END || account || ',' || balance AS line
  FROM balance_log)"""
TOTAL_LINES = """lines AS (
  SELECT tick, diff, CASE WHEN diff > 0 THEN 'insert ' ELSE 'delete ' END || total AS line FROM total_log)"""
EAGER_TOTAL_LOG = (*EAGER_RUNS, BALANCE_LOG, TOTALS, TOTAL_LOG)


@plan("render_retract", sql(*KEPT_RUNS, BALANCE_LOG, RETRACT_LINES, "SELECT tick, diff, line FROM lines"))
def render_retract(spark, folder):
    return render.retract_lines(_kept_balances(spark, folder), ["account", "balance"])


@plan(
    "render_retract_nulls",
    sql(
        TX,
        SELF_JOIN_LOG,
        """SELECT tick, diff, CASE WHEN diff > 0 THEN 'insert ' ELSE 'delete ' END || id || ','
       || coalesce(CAST(other_id AS VARCHAR), 'null') AS line FROM self_join_log""",
    ),
)
def render_retract_nulls(spark, folder):
    return render.retract_lines(C.self_join_changelog(transfers(spark, folder)), ["id", "other_id"])


@plan(
    "render_multiset",
    sql(
        TX,
        MARKED,
        KEPT,
        """bag AS (SELECT epoch_us(ts) AS tick, from_account, to_account, count(*) AS diff FROM kept
  GROUP BY ts, from_account, to_account)""",
        """SELECT tick, CAST(diff AS BIGINT) AS diff,
       'insert ' || diff || 'x (' || from_account || ', ' || to_account || ') at ' || tick AS line FROM bag""",
    ),
)
def render_multiset(spark, folder):
    """Account pairs as a bag: equal transfers of a tick become one counted line."""
    kept = kept_transfers(spark, folder)
    entries = kept.select(F.unix_micros("ts").alias("tick"), "from_account", "to_account", F.lit(1).alias("diff"))
    columns = ["from_account", "to_account"]
    return render.multiset_lines(C.consolidate(entries, columns), columns)


@plan("parse_totals", sql(*EAGER_TOTAL_LOG, "SELECT tick, total FROM total_log WHERE diff > 0"))
def parse_totals(spark, folder):
    """Totals read back out of the rendered insert and delete lines."""
    lines = render.retract_lines(C.total_changelog(C.eager_steps(transfers(spark, folder))), ["total"])
    return render.parse_totals(lines).select("tick", "total")


@plan("parse_json_totals", sql(*ARRIVAL_RUNS, BALANCE_LOG, TOTALS, "SELECT tick, total FROM totals"))
def parse_json_totals(spark, folder):
    """Totals read back out of JSON messages."""
    totals = C.total_by_tick(C.arrival_steps(transfers(spark, folder)))
    messages = totals.select("tick", F.to_json(F.struct("total")).alias("value"))
    return render.parse_json_totals(messages, "total")


@plan(
    "output_timeseries",
    sql(*EAGER_TOTAL_LOG, "SELECT row_number() OVER (ORDER BY tick) AS output_no, total FROM total_log WHERE diff > 0"),
)
def output_timeseries(spark, folder):
    steps = C.eager_steps(transfers(spark, folder))
    lines = render.retract_lines(C.total_changelog(steps), ["total"])
    return audit.output_timeseries(render.parse_totals(lines), ["tick"], steps.layout.unkeyed())


@plan("sink_readback", sql(*KEPT_RUNS, BALANCE_LOG, RETRACT_LINES, "SELECT line FROM lines"))
def sink_readback(spark, folder):
    """Rendered lines written as text files and read back."""
    path = fresh_path(spark, "lines")
    publish.write_lines(render.retract_lines(_kept_balances(spark, folder), ["account", "balance"]), path)
    return publish.read_lines(spark, path)
