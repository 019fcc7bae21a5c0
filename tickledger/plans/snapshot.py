"""Views of the whole input."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tickledger.functions import legs as L
from tickledger.functions import render
from tickledger.operators import changelog as C
from tickledger.operators import views as V
from tickledger.operators.named import register_views
from tickledger.plans.inputs import (
    KEPT,
    MARKED,
    ORDER_TX,
    TX,
    kept_transfers,
    legs,
    order_transfers,
    sql,
    transfers,
)
from tickledger.plans.registry import plan

AS_OF = datetime(2024, 1, 16, 0, 0)

CREDITS = "credits AS (SELECT to_account AS account, sum(amount) AS credits FROM tx GROUP BY to_account)"
DEBITS = "debits AS (SELECT from_account AS account, sum(amount) AS debits FROM tx GROUP BY from_account)"
BALANCE = """balance AS (
  SELECT credits.account, CAST(credits - debits AS BIGINT) AS balance
  FROM credits JOIN debits ON credits.account = debits.account)"""
CREDITS2 = "credits2 AS (SELECT to_account AS account, sum(amount) AS credits, max(ts) AS ts FROM tx GROUP BY to_account)"
DEBITS2 = "debits2 AS (SELECT from_account AS account, sum(amount) AS debits, max(ts) AS ts FROM tx GROUP BY from_account)"
BALANCE2 = """balance2 AS (
  SELECT credits2.account, CAST(credits - debits AS BIGINT) AS balance, credits2.ts
  FROM credits2 JOIN debits2 ON credits2.account = debits2.account AND credits2.ts = debits2.ts)"""
CREDITS_OUT = "SELECT account, CAST(credits AS BIGINT) AS credits FROM credits"
DEBITS_OUT = "SELECT account, CAST(debits AS BIGINT) AS debits FROM debits"
TOTAL_OUT = "SELECT CAST(sum(balance) AS BIGINT) AS total FROM balance"
SIGNED = """signed AS (
  SELECT id, to_account AS account, amount AS delta FROM tx
  UNION ALL SELECT id, from_account, -amount FROM tx)"""
UNION_OUT = "SELECT account, CAST(sum(delta) AS BIGINT) AS balance FROM signed GROUP BY account"
PAIRS_OUT = "SELECT t1.id, t2.id AS other_id FROM tx AS t1 LEFT JOIN {right} AS t2 ON t1.id = t2.id"


@plan("accepted_transactions", sql(TX, "SELECT id FROM tx"))
def accepted_transactions(spark, folder):
    return V.accepted_ids(transfers(spark, folder))


@plan("accepted_transactions_all", sql(TX, "SELECT * FROM tx"))
def accepted_transactions_all(spark, folder):
    return transfers(spark, folder)


@plan("credits", sql(TX, CREDITS, CREDITS_OUT))
def credits(spark, folder):
    return V.credits(transfers(spark, folder))


@plan("debits", sql(TX, DEBITS, DEBITS_OUT))
def debits(spark, folder):
    return V.debits(transfers(spark, folder))


@plan("balance", sql(TX, CREDITS, DEBITS, BALANCE, "SELECT * FROM balance"))
def balance(spark, folder):
    return V.balance(transfers(spark, folder))


@plan("total", sql(TX, CREDITS, DEBITS, BALANCE, TOTAL_OUT))
def total(spark, folder):
    return V.total(V.balance(transfers(spark, folder)))


@plan(
    "total_const_key",
    sql(TX, CREDITS, DEBITS, BALANCE, "SELECT 'foo' AS k, CAST(sum(balance) AS BIGINT) AS total FROM balance GROUP BY 'foo'"),
)
def total_const_key(spark, folder):
    return V.total_by_constant(V.balance(transfers(spark, folder)))


@plan("sums", sql(TX, "SELECT CAST(sum(amount) AS BIGINT) AS sums FROM tx"))
def sums(spark, folder):
    return V.sums(transfers(spark, folder))


@plan("credits_orders", sql(ORDER_TX, CREDITS, CREDITS_OUT))
def credits_orders(spark, folder):
    return V.credits(order_transfers(spark, folder))


@plan("debits_orders", sql(ORDER_TX, DEBITS, DEBITS_OUT))
def debits_orders(spark, folder):
    return V.debits(order_transfers(spark, folder))


@plan("balance_orders", sql(ORDER_TX, CREDITS, DEBITS, BALANCE, "SELECT * FROM balance"))
def balance_orders(spark, folder):
    return V.balance(order_transfers(spark, folder))


@plan("balance_join_orders", sql(ORDER_TX, CREDITS, DEBITS, BALANCE, "SELECT * FROM balance"))
def balance_join_orders(spark, folder):
    tx = order_transfers(spark, folder)
    return V.balance_by_join(V.credits(tx), V.debits(tx))


@plan("total_orders", sql(ORDER_TX, CREDITS, DEBITS, BALANCE, TOTAL_OUT))
def total_orders(spark, folder):
    return V.total(V.balance(order_transfers(spark, folder)))


@plan("balance_by_union", sql(TX, SIGNED, UNION_OUT))
def balance_by_union(spark, folder):
    return V.balance_by_union(transfers(spark, folder))


@plan("balance_by_union_orders", sql(ORDER_TX, SIGNED, UNION_OUT))
def balance_by_union_orders(spark, folder):
    return V.balance_by_union(order_transfers(spark, folder))


@plan("credits2", sql(TX, CREDITS2, "SELECT account, CAST(credits AS BIGINT) AS credits, ts FROM credits2"))
def credits2(spark, folder):
    return V.credits_with_time(transfers(spark, folder))


@plan("debits2", sql(TX, DEBITS2, "SELECT account, CAST(debits AS BIGINT) AS debits, ts FROM debits2"))
def debits2(spark, folder):
    return V.debits_with_time(transfers(spark, folder))


@plan("balance2", sql(TX, CREDITS2, DEBITS2, BALANCE2, "SELECT * FROM balance2"))
def balance2(spark, folder):
    return V.balance_with_time(transfers(spark, folder))


@plan("total2", sql(TX, CREDITS2, DEBITS2, BALANCE2, "SELECT CAST(sum(balance) AS BIGINT) AS total FROM balance2"))
def total2(spark, folder):
    return V.total(V.balance_with_time(transfers(spark, folder)))


@plan("outer_join", sql(TX, PAIRS_OUT.format(right="tx")))
def outer_join(spark, folder):
    tx = transfers(spark, folder)
    return V.outer_join(tx, tx)


@plan("outer_join_derived", sql(TX, MARKED, KEPT, PAIRS_OUT.format(right="kept")))
def outer_join_derived(spark, folder):
    """The right side is the published view, which lacks the late rows."""
    return V.outer_join(transfers(spark, folder), kept_transfers(spark, folder))


@plan(
    "outer_join_with_time",
    sql(TX, "SELECT t1.id, t2.id AS other_id FROM tx AS t1 LEFT JOIN tx AS t2 ON t1.id = t2.id AND t1.ts = t2.ts"),
)
def outer_join_with_time(spark, folder):
    tx = transfers(spark, folder)
    return V.outer_join_with_time(tx, tx)


@plan("signed_legs", sql(TX, SIGNED, "SELECT * FROM signed"))
def signed_legs(spark, folder):
    return L.signed_legs(transfers(spark, folder), "id")


@plan(
    "legs_union",
    sql(TX, "SELECT from_account AS account, amount FROM tx UNION ALL SELECT to_account, amount FROM tx"),
)
def legs_union(spark, folder):
    tx = transfers(spark, folder)
    return L.debit_legs(tx).unionByName(L.credit_legs(tx))


@plan(
    "net_per_tick",
    sql(
        TX,
        legs("tx", "epoch_us(ts)", "epoch_us(ts)"),
        "SELECT tick, account, CAST(sum(c - d) AS BIGINT) AS net FROM legs GROUP BY tick, account",
    ),
)
def net_per_tick(spark, folder):
    return V.net_per_tick(transfers(spark, folder))


@plan(
    "running_total",
    sql(
        ORDER_TX,
        "per_tick AS (SELECT epoch_us(ts) AS tick, sum(amount) AS delta FROM tx GROUP BY ts)",
        """SELECT tick, CAST(delta AS BIGINT) AS delta,
       CAST(sum(delta) OVER (ORDER BY tick ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM per_tick""",
    ),
)
def running_total(spark, folder):
    tx = order_transfers(spark, folder)
    per_tick = tx.groupBy(F.unix_micros("ts").alias("tick")).agg(F.sum("amount").alias("delta"))
    return C.running_total(per_tick)


@plan("as_of_transactions", sql(TX, "SELECT * FROM tx WHERE ts <= TIMESTAMP '2024-01-16 00:00:00'"))
def as_of_transactions(spark, folder):
    return V.as_of(transfers(spark, folder), F.lit(AS_OF.isoformat(sep=" ")).cast("timestamp"))


@plan(
    "view_to_json",
    sql(
        TX,
        CREDITS,
        DEBITS,
        BALANCE,
        """SELECT CAST(account AS VARCHAR) AS key,
       '{"account":' || account || ',"balance":' || balance || '}' AS value FROM balance""",
    ),
)
def view_to_json(spark, folder):
    return render.json_messages(V.balance(transfers(spark, folder)), "account")


SQL_BALANCE = """SELECT {p}credits.account, {p}credits.credits - {p}debits.debits AS balance
FROM {p}credits, {p}debits WHERE {p}credits.account = {p}debits.account"""


@plan("sql_views_balance", sql(TX, CREDITS, DEBITS, BALANCE, "SELECT * FROM balance"))
def sql_views_balance(spark, folder):
    """The balance view written in Spark SQL over the named views."""
    register_views(transfers(spark, folder), prefix="ledger_")
    return spark.sql(SQL_BALANCE.format(p="ledger_"))


@plan(
    "sql_views_totals",
    sql(
        TX,
        CREDITS,
        DEBITS,
        BALANCE,
        CREDITS2,
        DEBITS2,
        BALANCE2,
        """SELECT CAST((SELECT sum(balance) FROM balance) AS BIGINT) AS total,
       CAST((SELECT sum(balance) FROM balance2) AS BIGINT) AS total2""",
    ),
)
def sql_views_totals(spark, folder):
    register_views(transfers(spark, folder), prefix="ledger_")
    return spark.sql("SELECT (SELECT total FROM ledger_total) AS total, (SELECT total FROM ledger_total2) AS total2")
