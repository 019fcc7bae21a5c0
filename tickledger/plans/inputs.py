"""Inputs of the registered queries, in Spark and as SQL common table expressions."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession

from tickledger.operators import lateness
from tickledger.sources import tables

DELAY = timedelta(hours=4)
WATERMARK_EVERY = 100
GRANULE = "1 hour"


def transfers(spark: SparkSession, folder: str) -> DataFrame:
    return tables.ledger_from_events(tables.table(spark, folder, "events"))


def kept_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return lateness.accepted(transfers(spark, folder), DELAY)


def order_transfers(spark: SparkSession, folder: str) -> DataFrame:
    return tables.ledger_from_orders(tables.table(spark, folder, "orders"))


def upserts(spark: SparkSession, folder: str) -> DataFrame:
    return tables.upserts_from_events(tables.table(spark, folder, "events"))


# -------------------------------------------------------------------------- SQL pieces

TX = """tx AS (
  SELECT event_id AS id, CAST(user_id % 10 AS INTEGER) AS from_account,
         CAST((user_id + CAST(json_extract_string(props, '$.k') AS INTEGER)) % 10 AS INTEGER) AS to_account,
         CAST(round(value * 100) AS BIGINT) AS amount, date_trunc('hour', ts) AS ts,
         event_id + (event_id * 7919) % 211 AS arrival
  FROM events)"""

ORDER_TX = """tx AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS INTEGER) AS from_account,
         CAST((o_custkey * 31 + o_orderkey) % 1600 AS INTEGER) AS to_account,
         CAST(round(o_totalprice * 100) AS BIGINT) AS amount, o_orderdate AS ts, o_orderkey AS arrival
  FROM orders)"""

MARKED = """marked AS (
  SELECT *, max(ts) OVER (ORDER BY arrival, id ROWS UNBOUNDED PRECEDING) - INTERVAL 4 HOUR AS watermark FROM tx)"""

KEPT = "kept AS (SELECT id, from_account, to_account, amount, ts, arrival FROM marked WHERE ts >= watermark)"

UPSERTS = "upserts AS (SELECT *, id % 500 AS key FROM tx)"


def sql(*parts: str) -> str:
    """The last part is the query, the ones before it are its CTEs."""
    *ctes, body = parts
    return f"WITH {', '.join(ctes)}\n{body}" if ctes else body


def legs(source: str, credit_tick: str, debit_tick: str) -> str:
    return f"""legs AS (
  SELECT to_account AS account, {credit_tick} AS tick, amount AS c, 0 AS d, 1 AS nc, 0 AS nd FROM {source}
  UNION ALL
  SELECT from_account, {debit_tick}, 0, amount, 0, 1 FROM {source})"""


# Running sides of each account after every tick that touched it.
RUNS = """steps AS (
  SELECT account, tick, sum(c) AS c, sum(d) AS d, sum(nc) AS nc, sum(nd) AS nd FROM legs GROUP BY account, tick),
runs AS (
  SELECT account, tick, nc, nd, sum(c) OVER w AS rc, sum(d) OVER w AS rd, sum(nc) OVER w AS rnc, sum(nd) OVER w AS rnd
  FROM steps WINDOW w AS (PARTITION BY account ORDER BY tick ROWS UNBOUNDED PRECEDING))"""

EVENT_TICKS = ("epoch_us(ts)", "epoch_us(ts)")
ARRIVAL_TICKS = ("arrival", "arrival")
EAGER_TICKS = ("2 * arrival", "2 * arrival + 1")


def side_log(name: str, value: str, rows: str) -> str:
    """`credits` or `debits` as a changelog CTE named <name>_log."""
    return f"""{name}_states AS (
  SELECT account, tick, {value} AS v, lag({value}) OVER (PARTITION BY account ORDER BY tick) AS old
  FROM runs WHERE {rows} > 0),
{name}_log AS (
  SELECT tick, account, CAST(old AS BIGINT) AS {name}, -1 AS diff FROM {name}_states WHERE old <> v
  UNION ALL
  SELECT tick, account, CAST(v AS BIGINT), 1 FROM {name}_states WHERE old IS NULL OR old <> v)"""


CREDITS_LOG = side_log("credits", "rc", "nc")
DEBITS_LOG = side_log("debits", "rd", "nd")

BALANCE_LOG = """balances AS (
  SELECT account, tick, rc - rd AS v, lag(rc - rd) OVER (PARTITION BY account ORDER BY tick) AS old
  FROM runs WHERE rnc > 0 AND rnd > 0),
balance_log AS (
  SELECT tick, account, CAST(old AS BIGINT) AS balance, -1 AS diff FROM balances WHERE old <> v
  UNION ALL
  SELECT tick, account, CAST(v AS BIGINT), 1 FROM balances WHERE old IS NULL OR old <> v)"""

TOTALS = """moves AS (SELECT tick, sum(balance * diff) AS delta FROM balance_log GROUP BY tick),
totals AS (SELECT tick, CAST(sum(delta) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM moves)"""

TOTAL_LOG = """total_states AS (SELECT tick, total, lag(total) OVER (ORDER BY tick) AS old FROM totals),
total_log AS (
  SELECT tick, old AS total, -1 AS diff FROM total_states WHERE old <> total
  UNION ALL
  SELECT tick, total, 1 FROM total_states WHERE old IS NULL OR old <> total)"""

SELF_JOIN_LOG = """self_join_log AS (
  SELECT 2 * arrival AS tick, id, CAST(NULL AS BIGINT) AS other_id, 1 AS diff FROM tx
  UNION ALL
  SELECT 2 * arrival + 1, id, NULL, -1 FROM tx
  UNION ALL
  SELECT 2 * arrival + 1, t1.id, t2.id, 1 FROM tx AS t1 JOIN (SELECT id FROM tx) AS t2 ON t1.id = t2.id)"""


def timed_runs(source: str, credit_tick: str, debit_tick: str) -> tuple[str, ...]:
    """Running sums and newest times of both sides after every tick that touched an account."""
    return (
        f"""timed_legs AS (
  SELECT to_account AS account, {credit_tick} AS tick, amount AS c, 0 AS d, ts AS cts, NULL AS dts FROM {source}
  UNION ALL
  SELECT from_account, {debit_tick}, 0, amount, NULL, ts FROM {source})""",
        """timed_steps AS (
  SELECT account, tick, sum(c) AS c, sum(d) AS d, max(cts) AS cts, max(dts) AS dts FROM timed_legs GROUP BY account, tick)""",
        """timed_runs AS (
  SELECT account, tick, cts, dts, sum(c) OVER w AS rc, sum(d) OVER w AS rd, max(cts) OVER w AS rcts, max(dts) OVER w AS rdts
  FROM timed_steps WINDOW w AS (PARTITION BY account ORDER BY tick ROWS UNBOUNDED PRECEDING))""",
    )


def timed_side_log(name: str, value: str, ts: str) -> str:
    """`credits` or `debits` with its newest time as a changelog CTE named <name>2_log."""
    return f"""{name}2_states AS (
  SELECT account, tick, {value} AS v, r{ts} AS ts, lag({value}) OVER w AS old, lag(r{ts}) OVER w AS old_ts
  FROM timed_runs WHERE {ts} IS NOT NULL WINDOW w AS (PARTITION BY account ORDER BY tick)),
{name}2_log AS (
  SELECT tick, account, CAST(old AS BIGINT) AS {name}, old_ts AS ts, -1 AS diff FROM {name}2_states
  WHERE old_ts IS NOT NULL AND (old <> v OR old_ts <> ts)
  UNION ALL
  SELECT tick, account, CAST(v AS BIGINT), ts, 1 FROM {name}2_states WHERE old_ts IS NULL OR old <> v OR old_ts <> ts)"""


CREDITS2_LOG = timed_side_log("credits", "rc", "cts")
DEBITS2_LOG = timed_side_log("debits", "rd", "dts")

BALANCE2_LOG = """balance2_states AS (
  SELECT account, tick, rc - rd AS v, rcts AS ts, coalesce(rcts = rdts, false) AS is_on,
         lag(rc - rd) OVER w AS old, lag(rcts) OVER w AS old_ts, coalesce(lag(rcts = rdts) OVER w, false) AS was_on
  FROM timed_runs WINDOW w AS (PARTITION BY account ORDER BY tick)),
balance2_log AS (
  SELECT tick, account, CAST(old AS BIGINT) AS balance, old_ts AS ts, -1 AS diff FROM balance2_states
  WHERE was_on AND (NOT is_on OR old <> v OR old_ts <> ts)
  UNION ALL
  SELECT tick, account, CAST(v AS BIGINT), ts, 1 FROM balance2_states WHERE is_on AND (NOT was_on OR old <> v OR old_ts <> ts))"""

TOTAL2_LOG = """total2_moves AS (
  SELECT tick, sum(balance * diff) AS delta, sum(diff) AS accounts FROM balance2_log GROUP BY tick),
total2_states AS (
  SELECT tick, delta, sum(delta) OVER w AS total, accounts, sum(accounts) OVER w AS on_now
  FROM total2_moves WINDOW w AS (ORDER BY tick ROWS UNBOUNDED PRECEDING)),
total2_log AS (
  SELECT tick, CAST(total - delta AS BIGINT) AS total, -1 AS diff FROM total2_states
  WHERE on_now - accounts > 0 AND (on_now = 0 OR delta <> 0)
  UNION ALL
  SELECT tick, CAST(total AS BIGINT), 1 FROM total2_states WHERE on_now > 0 AND (on_now - accounts = 0 OR delta <> 0))"""
