"""Streaming queries over the stored tables, run until the input is used up."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickledger.functions import render
from tickledger.operators import changelog as C
from tickledger.operators import lateness
from tickledger.plans.audits import ZERO_SUM
from tickledger.plans.histories import FULL_RUNS, RETRACTIONS
from tickledger.plans.late import LATE_REFINEMENTS, NUMBERED
from tickledger.plans.inputs import (
    BALANCE_LOG,
    DELAY,
    GRANULE,
    KEPT,
    MARKED,
    SELF_JOIN_LOG,
    TOTAL_LOG,
    TOTALS,
    TX,
    UPSERTS,
    WATERMARK_EVERY,
    legs,
    sql,
    transfers,
)
from tickledger.plans.registry import plan
from tickledger.plans.snapshot import PAIRS_OUT
from tickledger.schema import TX_SCHEMA
from tickledger.sources import replay, tables
from tickledger.sources import transactions as S
from tickledger.sinks import committed
from tickledger.sources.lines import listed, stream_lines
from tickledger.streaming import joins, progress, publish, timers, views
from tickledger.streaming.log_table import LogTable, newest
from tickledger.workspace import fresh_path

# Longer than any row is delayed, so that no batch boundary makes a row late.
PATIENCE = timedelta(days=10)
REPLAY_BATCHES = 4
LATE_BATCHES = 8
#: Line replays read so much at a time, and a quarter of what there is where that is less, so that there are several batches.
REPLAY_BYTES = 1 << 30
#: Of the left join's two sides, so a bucket has twice as many rows.
JOIN_ROWS_PER_BUCKET = 5_000


def bytes_per_batch(path: str) -> int:
    return min(REPLAY_BYTES, -(-sum(size for _, size in listed(path)) // 4) or 1)



def live_events(spark: SparkSession, folder: str) -> DataFrame:
    stored = tables.table(spark, folder, "events").schema
    return replay.stream_table(spark, folder, "events", stored)


def live_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return tables.ledger_from_events(live_events(spark, folder))


def replay_readers(spark: SparkSession, folder: str) -> Callable[[], DataFrame]:
    """Each call reads the stored transfers as a stream in several micro-batches of bounded size, by arrival."""
    path = fresh_path(spark, "replay")
    rows = transfers(spark, folder).unionByName(publish.closing_row(spark))
    each = replay.write_replay(rows, path, REPLAY_BATCHES)
    return lambda: replay.stream_files(spark, path, TX_SCHEMA, files_per_batch=each)


def replayed_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return replay_readers(spark, folder)()


def replayed_upserts(spark: SparkSession, folder: str) -> DataFrame:
    return replayed_transfers(spark, folder).where(F.col("id") >= 0).withColumn("key", F.col("id") % tables.UPSERT_KEYS)


def _published(view: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """The finished stream's rows; an error if it read nothing of a table in `folder` that has rows."""
    spark = view.sparkSession
    path = fresh_path(spark, label)
    query = publish.append_to(view, f"{path}/rows", f"{path}/checkpoint")
    if folder is not None and publish.unread_sources(query) and not tables.table(spark, folder, "events").isEmpty():
        raise RuntimeError(f"no rows were read from {publish.unread_sources(query)}")
    return spark.read.schema(view.schema).parquet(f"{path}/rows")


def _replayed(view, rows, lines: str, label: str, whole_files: bool = False) -> DataFrame:
    """The finished stream of `view` over the `rows` of line files, replayed by name in bounded batches."""
    spark = SparkSession.active()
    path = fresh_path(spark, label)
    replayed = rows(stream_lines(spark, lines, f"{path}/checkpoint", bytes_per_batch=bytes_per_batch(lines), whole_files=whole_files))
    seen = view(replayed)
    publish.run_until_read(seen.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows"), f"{path}/checkpoint")
    return spark.read.schema(seen.schema).parquet(f"{path}/rows")


EVENT_LEGS = legs("tx", "epoch_us(ts)", "epoch_us(ts)")
NET = "SELECT tick, account, CAST(sum(c - d) AS BIGINT) AS net FROM legs GROUP BY tick, account"


@plan("stream_net_per_tick", sql(TX, EVENT_LEGS, NET))
def stream_net_per_tick(spark, folder):
    closed = publish.closed_stream(live_transfers(spark, folder))
    return _published(views.net_per_tick(closed, DELAY, GRANULE), "net-per-tick", folder)


@plan("stream_net_per_tick_replay", sql(TX, EVENT_LEGS, NET))
def stream_net_per_tick_replay(spark, folder):
    replayed = replayed_transfers(spark, folder)
    return _published(views.net_per_tick(replayed, PATIENCE, GRANULE), "net-per-tick")


#: One account's transfers stream up to three batches after their time. A batch drops what ended before the watermark
#: of the batches up to the one before the last, which is when Spark moves it.
DELAYED = f"""delayed AS (
  SELECT *, id * {LATE_BATCHES} // (SELECT max(id) + 1 FROM tx) + CASE WHEN from_account = 3 THEN id % 4 ELSE 0 END AS batch FROM tx),
batches AS (
  SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS high FROM delayed GROUP BY batch),
on_time AS (
  SELECT delayed.* FROM delayed JOIN batches USING (batch) WHERE high IS NULL OR ts + INTERVAL 1 HOUR > high - INTERVAL 4 HOUR)"""


@plan("stream_net_per_tick_late", sql(TX, DELAYED, legs("on_time", "epoch_us(ts)", "epoch_us(ts)"), NET))
def stream_net_per_tick_late(spark, folder):
    """Net changes of closed ticks, without the rows that came after their tick was closed."""
    rows = transfers(spark, folder)
    span = (rows.agg(F.max("id")).first()[0] or 0) + 1
    behind = F.when(F.col("from_account") == 3, F.col("id") % 4).otherwise(0)
    batch = F.when(F.col("id") < 0, LATE_BATCHES + 3).otherwise(F.expr(f"id * {LATE_BATCHES} div {span}") + behind)
    path = fresh_path(spark, "delayed")
    each = replay.write_batches(rows.unionByName(publish.closing_row(spark)), batch, LATE_BATCHES + 4, path)
    delayed = replay.stream_files(spark, path, TX_SCHEMA, files_per_batch=each)
    return _published(views.net_per_tick(delayed, DELAY, GRANULE), "net-per-tick-late")


@plan(
    "total_finalized",
    sql(
        TX,
        EVENT_LEGS,
        """SELECT tick, CAST(sum(c - d) AS BIGINT) AS total, count(DISTINCT account) AS accounts FROM legs GROUP BY tick""",
    ),
)
def total_finalized(spark, folder):
    """Closed ticks only, and in each of them the net changes of all accounts add up to 0."""
    return _published(views.total_per_tick(replayed_transfers(spark, folder), PATIENCE, GRANULE), "totals")


@plan(
    "stream_balance_per_tick_join",
    sql(
        TX,
        "cr AS (SELECT ts, to_account AS account, sum(amount) AS credits FROM tx GROUP BY ts, to_account)",
        "de AS (SELECT ts, from_account AS account, sum(amount) AS debits FROM tx GROUP BY ts, from_account)",
        """SELECT epoch_us(ts) AS tick, account, CAST(credits - debits AS BIGINT) AS balance
FROM cr JOIN de USING (ts, account)""",
    ),
)
def stream_balance_per_tick_join(spark, folder):
    replayed = replay_readers(spark, folder)
    joined = views.balance_per_tick_by_join(replayed(), replayed(), PATIENCE, GRANULE)
    return _published(joined, "balance-per-tick")


@plan("stream_outer_join_with_time", sql(TX, PAIRS_OUT.format(right="tx")))
def stream_outer_join_with_time(spark, folder):
    replayed = replay_readers(spark, folder)
    joined = views.outer_join_with_time(replayed(), replayed(), PATIENCE)
    return _published(joined, "outer-join").where("id >= 0")


@plan(
    "stream_accounts_eager",
    sql(
        TX,
        EVENT_LEGS,
        """SELECT account, CAST(sum(c) AS BIGINT) AS credit, CAST(sum(d) AS BIGINT) AS debit,
       CAST(sum(nc) AS BIGINT) AS credit_rows, CAST(sum(nd) AS BIGINT) AS debit_rows FROM legs GROUP BY account""",
    ),
)
def stream_accounts_eager(spark, folder):
    """The newest published state of every account, after several eager batches."""
    path = fresh_path(spark, "accounts")
    replayed = replayed_transfers(spark, folder).where(F.col("id") >= 0)
    publish.publish_states(views.eager_accounts(replayed), f"{path}/states", f"{path}/checkpoint")
    states = publish.read_batches(spark, f"{path}/states")
    return C.latest(states, "account", "batch").drop("batch")


@plan(
    "stream_upserts",
    sql(
        TX,
        UPSERTS,
        """SELECT id, from_account, to_account, amount, ts, arrival, key FROM upserts
QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC, id DESC) = 1""",
    ),
)
def stream_upserts(spark, folder):
    """The newest row of each key, from the base of a keyed table and the runs after it."""
    path = fresh_path(spark, "upserts")
    view = views.upserted(replayed_upserts(spark, folder), "key", "arrival")
    table = LogTable(spark, f"{path}/table", ("key",), view.schema, newest(["key"], "arrival"), most_runs=2)
    publish.publish_table(view, table, f"{path}/checkpoint")
    return table.state()


@plan(
    "stream_retractable_sum",
    sql(
        TX,
        UPSERTS,
        "newest AS (SELECT * FROM upserts QUALIFY row_number() OVER (PARTITION BY key ORDER BY arrival DESC, id DESC) = 1)",
        "SELECT to_account, CAST(sum(amount) AS BIGINT) AS credits FROM newest GROUP BY to_account",
    ),
)
def stream_retractable_sum(spark, folder):
    """Credits of a keyed table, kept up batch by batch: the replaced row comes from its key's state."""
    path = fresh_path(spark, "retractable")
    changes = joins.retractions(replayed_upserts(spark, folder), "key", "arrival", "to_account", "amount")
    table = joins.sums_table(spark, f"{path}/table", "to_account", "credits", most_runs=2)
    joins.publish_retractable_sums(changes, table, f"{path}/checkpoint")
    return table.state().where("copies > 0").select("to_account", "credits")


@plan("stream_retractions", sql(TX, UPSERTS, RETRACTIONS, "SELECT tick, key, to_account, amount, diff FROM retractions"))
def stream_retractions(spark, folder):
    changes = joins.retractions(replayed_upserts(spark, folder), "key", "arrival", "to_account", "amount")
    return _published(changes.withColumnRenamed("grouped", "to_account"), "retractions")


@plan("stream_outer_join_changelog", sql(TX, SELF_JOIN_LOG, "SELECT tick, id, other_id, diff FROM self_join_log"))
def stream_outer_join_changelog(spark, folder):
    """The left self join without time: each id is published unmatched, and that row taken back when its match comes."""
    rows = replayed_transfers(spark, folder)
    id_ = F.col("id")
    tick = F.when(id_ >= 0, F.col("arrival") * 2).otherwise(0)  # the closing row's position is too large to double
    left = rows.select(id_.alias("key"), tick.alias("tick"), id_.alias("value"), "ts")
    right = rows.select(id_.alias("key"), (tick + 1).alias("tick"), id_.alias("value"), "ts")
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), transfers(spark, folder).count() // JOIN_ROWS_PER_BUCKET)
    log = _published(joins.outer_join_changelog(left, right, PATIENCE, buckets=buckets), "outer-join-log")
    return log.select("tick", F.col("left").alias("id"), F.col("right").alias("other_id"), "diff")


@plan("stream_join_changelogs", sql(*FULL_RUNS, BALANCE_LOG, "SELECT tick, account, balance, diff FROM balance_log"))
def stream_join_changelogs(spark, folder):
    """The balance history from the published credit and debit entries alone, joined as their ticks close."""
    path = fresh_path(spark, "histories")
    steps = views.account_steps(replayed_transfers(spark, folder), PATIENCE, GRANULE)
    publish.publish_changelogs(steps, path, f"{path}/checkpoint", entries=True, names=("credits", "debits"))
    publish.close_lines(spark, f"{path}/entries")

    def entries(lines: DataFrame) -> DataFrame:
        return lines.select(F.from_json("line", joins.ENTRY, {"mode": "FAILFAST"}).alias("entry")).select("entry.*")

    return _replayed(lambda rows: joins.join_changelogs(rows, lambda c, d: c - d, "balance"), entries, f"{path}/entries", "joined", whole_files=True)


def _stream_history(view: str, log: tuple[str, ...], out: str) -> None:
    @plan(f"stream_{view}_changelog", sql(*FULL_RUNS, *log, out))
    def stream_changelog(spark, folder):
        """Written by one streaming query, batch by batch, together with the other views."""
        path = fresh_path(spark, "histories")
        steps = views.account_steps(replayed_transfers(spark, folder), PATIENCE, GRANULE)
        publish.publish_changelogs(steps, path, f"{path}/checkpoint")
        return publish.read_batches(spark, f"{path}/{view}").drop("batch")


_stream_history("balance", (BALANCE_LOG,), "SELECT tick, account, balance, diff FROM balance_log")
_stream_history("total", (BALANCE_LOG, TOTALS, TOTAL_LOG), "SELECT tick, total, diff FROM total_log")


@plan("stream_accepted_on_time", sql(TX, MARKED, KEPT, "SELECT * FROM kept"))
def stream_accepted_on_time(spark, folder):
    """Late rows are dropped one by one, over several batches, as in the batch form."""
    path = fresh_path(spark, "accepted")
    replayed = replayed_transfers(spark, folder).where(F.col("id") >= 0)
    publish.publish_accepted(replayed, DELAY, path, f"{path}/checkpoint")
    return publish.read_batches(spark, f"{path}/rows").drop("batch")


@plan("stream_pass_through", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_pass_through(spark, folder):
    return _published(live_events(spark, folder), "pass-through", folder)


@plan("stream_messages", sql(TX, "SELECT id, from_account, to_account, amount, ts FROM tx"))
def stream_messages(spark, folder):
    """Published as keyed JSON messages and decoded again."""
    keyed = live_transfers(spark, folder).select("id", S.json_document().alias("value"))
    messages = keyed.select(F.col("id").cast("string").alias("key"), "value")
    return S.decode_json(_published(messages, "messages", folder).select("value"))


@plan("stream_json_lines", sql(TX, "SELECT id, from_account, to_account, amount, ts FROM tx"))
def stream_json_lines(spark, folder):
    """JSON lines written to a folder, then streamed through the strict reader."""
    path = fresh_path(spark, "json-lines")
    transfers(spark, folder).select(S.json_document().alias("line")).write.text(path)
    return _published(S.stream_json_lines(spark, path), "transfers")


@plan(
    "stream_net_messages",
    sql(
        TX,
        EVENT_LEGS,
        f"""SELECT CAST(account AS VARCHAR) AS key,
       '{{"tick":' || tick || ',"account":' || account || ',"net":' || net || '}}' AS value FROM ({NET}) AS n""",
    ),
)
def stream_net_messages(spark, folder):
    """A closed view as JSON messages."""
    nets = views.net_per_tick(replayed_transfers(spark, folder), PATIENCE, GRANULE)
    return _published(render.json_messages(nets, "account"), "net-messages")


@plan("stream_timer_nets", sql(TX, EVENT_LEGS, NET))
def stream_timer_nets(spark, folder):
    """The net changes of closed ticks from a keyed process function with event-time timers."""
    return _published(timers.timer_nets(replayed_transfers(spark, folder), PATIENCE), "timer-nets")


@plan("stream_late_refinements", LATE_REFINEMENTS)
def stream_late_refinements(spark, folder):
    """Partial results as they fire: the first stream marks rows, the second one holds state and timers."""
    path = fresh_path(spark, "marked")
    timers.publish_marked(replayed_transfers(spark, folder), WATERMARK_EVERY, DELAY, path, f"{path}/checkpoint")
    return _replayed(timers.late_refinements, timers.marked_rows, f"{path}/rows", "late-refinements", whole_files=True)


@plan("stream_replay_lines", sql(TX, NUMBERED, "SELECT id, from_account, to_account, amount, ts, row_no FROM numbered"))
def stream_replay_lines(spark, folder):
    """JSON lines streamed by file name and byte, whatever the files' times, and numbered by file and position."""
    path = fresh_path(spark, "json-lines")
    rows = transfers(spark, folder)
    rows.repartitionByRange("arrival", "id").sortWithinPartitions("arrival", "id").select(S.json_document().alias("line")).write.text(path)
    decoded = _replayed(lambda lines: S.decode_json(lines, "line"), lambda lines: lines, path, "replayed-lines")
    file_no = F.regexp_extract("file", "part-([0-9]+)", 1).cast("bigint")
    placed = decoded.withColumn("arrival", F.call_function("shiftleft", file_no, F.lit(40)) + F.col("position"))
    return lateness.numbered(placed).select("id", "from_account", "to_account", "amount", "ts", "row_no")


@plan("stream_committed_lines", sql(TX, EVENT_LEGS, f"""SELECT '{{"tick":' || tick || ',"account":' || account || ',"net":' || net || '}}' AS line FROM ({NET}) AS n"""))
def stream_committed_lines(spark, folder):
    """A closed view through the sink with two phases, read back by its manifests."""
    path = fresh_path(spark, "committed")
    nets = views.net_per_tick(replayed_transfers(spark, folder), PATIENCE, GRANULE)
    lines = render.json_messages(nets, "account").select(F.col("value").alias("line"))
    publish.run_available(committed.write_stream(lines, f"{path}/out"), f"{path}/checkpoint")
    return committed.read(spark, f"{path}/out")


@plan("stream_audit_zero_sum", sql(*FULL_RUNS, BALANCE_LOG, TOTALS, ZERO_SUM))
def stream_audit_zero_sum(spark, folder):
    """The zero-sum audit as observed while the histories are published, without a second read of them."""
    path = fresh_path(spark, "audited")
    steps = views.account_steps(replayed_transfers(spark, folder), PATIENCE, GRANULE)
    publish.publish_changelogs(steps, path, f"{path}/checkpoint", audit=True, names=())
    return progress.zero_sum_of(publish.read_batches(spark, f"{path}/audit"))


@plan(
    "stream_state_accounts",
    sql(
        TX,
        EVENT_LEGS,
        """SELECT account, CAST(sum(c) AS BIGINT) AS credit, CAST(sum(d) AS BIGINT) AS debit,
       CAST(sum(nc) AS BIGINT) AS credit_rows, CAST(sum(nd) AS BIGINT) AS debit_rows FROM legs GROUP BY account""",
    ),
)
def stream_state_accounts(spark, folder):
    """The sides of all accounts out of the checkpoint of a finished query."""
    path = fresh_path(spark, "state")
    replayed = replayed_transfers(spark, folder).where(F.col("id") >= 0)
    publish.publish_states(views.eager_accounts(replayed), f"{path}/states", f"{path}/checkpoint")
    return progress.account_sides(spark, f"{path}/checkpoint")


@plan("stream_progress_lines", sql(TX, EVENT_LEGS, "SELECT DISTINCT tick, TRUE AS told FROM legs"))
def stream_progress_lines(spark, folder):
    """Each published tick, and whether a listener was told a watermark behind it that no earlier line contradicts."""
    listener = progress.ProgressLines()
    spark.streams.addListener(listener)
    try:
        path = fresh_path(spark, "progress")
        view = views.net_per_tick(replayed_transfers(spark, folder), PATIENCE, GRANULE)
        query = publish.append_to(view, f"{path}/rows", f"{path}/checkpoint")
        marks = listener.marks(query)
    finally:
        spark.streams.removeListener(listener)
    rising = all(a < b for a, b in zip(marks, marks[1:]))
    highest = max((at for _, at in marks), default=0)
    rows = spark.read.schema(view.schema).parquet(f"{path}/rows")
    return rows.select("tick").distinct().withColumn("told", (F.col("tick") < highest) & F.lit(rising))
