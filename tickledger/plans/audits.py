"""Is what was published consistent?"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickledger.functions.legs import two_sided_legs
from tickledger.operators import audit
from tickledger.operators import changelog as C
from tickledger.operators import views as V
from tickledger.plans.histories import (
    ARRIVAL_RUNS,
    EAGER_RUNS,
    KEPT_RUNS,
    SNAPSHOT_AT,
    UNION_TOTALS,
)
from tickledger.plans.inputs import (
    BALANCE_LOG,
    CREDITS_LOG,
    DEBITS_LOG,
    EAGER_TICKS,
    EVENT_TICKS,
    KEPT,
    MARKED,
    ORDER_TX,
    SELF_JOIN_LOG,
    TOTALS,
    TX,
    kept_transfers,
    legs,
    order_transfers,
    sql,
    transfers,
)
from tickledger.plans.registry import plan
from tickledger.plans.snapshot import BALANCE, BALANCE2, CREDITS, CREDITS2, DEBITS, DEBITS2

ZERO_SUM = """SELECT count(*) AS outputs, count(*) FILTER (total <> 0) AS nonzero,
       min(tick) FILTER (total <> 0) AS first_nonzero, max(tick) FILTER (total <> 0) AS last_nonzero,
       max(abs(total)) AS max_abs FROM totals"""
UNION = f"totals AS ({UNION_TOTALS})"
SETTLED = """seen AS (
  SELECT account, min(tick) FILTER (nc > 0) AS credited, min(tick) FILTER (nd > 0) AS debited FROM runs GROUP BY account),
settled AS (SELECT CASE WHEN count(*) = count(credited) AND count(*) = count(debited)
                        THEN max(greatest(credited, debited)) END AS tick FROM seen)"""
ONCE_SETTLED = ZERO_SUM + " WHERE tick >= (SELECT tick FROM settled)"


@plan("audit_zero_sum", sql(*KEPT_RUNS, BALANCE_LOG, TOTALS, ZERO_SUM))
def audit_zero_sum(spark, folder):
    return audit.zero_sum(C.total_by_tick(C.event_time_steps(kept_transfers(spark, folder))))


@plan("audit_zero_sum_settled", sql(*KEPT_RUNS, BALANCE_LOG, TOTALS, SETTLED, ONCE_SETTLED))
def audit_zero_sum_settled(spark, folder):
    steps = C.event_time_steps(kept_transfers(spark, folder))
    return audit.zero_sum_once_settled(C.total_by_tick(steps), steps)


@plan("audit_zero_sum_union", sql(TX, MARKED, KEPT, legs("kept", *EVENT_TICKS), UNION, ZERO_SUM))
def audit_zero_sum_union(spark, folder):
    return audit.zero_sum(C.union_total_by_tick(C.event_time_steps(kept_transfers(spark, folder))))


@plan("audit_zero_sum_by_arrival", sql(*ARRIVAL_RUNS, BALANCE_LOG, TOTALS, SETTLED, ONCE_SETTLED))
def audit_zero_sum_by_arrival(spark, folder):
    """Both legs of a transfer in one tick: consistent although nothing waits."""
    steps = C.arrival_steps(transfers(spark, folder))
    return audit.zero_sum_once_settled(C.total_by_tick(steps), steps)


@plan("audit_zero_sum_eager", sql(*EAGER_RUNS, BALANCE_LOG, TOTALS, ZERO_SUM))
def audit_zero_sum_eager(spark, folder):
    """The control: eager outputs between the two legs of a transfer are off."""
    return audit.zero_sum(C.total_by_tick(C.eager_steps(transfers(spark, folder))))


@plan("audit_zero_sum_union_eager", sql(TX, legs("tx", *EAGER_TICKS), UNION, ZERO_SUM))
def audit_zero_sum_union_eager(spark, folder):
    return audit.zero_sum(C.union_total_by_tick(C.eager_steps(transfers(spark, folder))))


@plan(
    "audit_outer_join",
    sql(
        TX,
        SELF_JOIN_LOG,
        """SELECT count(*) FILTER (diff > 0) AS outputs, count(*) FILTER (diff > 0 AND other_id IS NULL) AS unmatched_outputs,
       CAST(sum(CASE WHEN other_id IS NULL THEN diff ELSE 0 END) AS BIGINT) AS unmatched_at_end FROM self_join_log""",
    ),
)
def audit_outer_join(spark, folder):
    return audit.unmatched(C.self_join_changelog(transfers(spark, folder)))


ALIGNMENT = """SELECT count(*) AS accounts, count(b2.account) AS aligned, count(*) - count(b2.account) AS unaligned,
       CAST(sum(b.balance) FILTER (b2.account IS NULL) AS BIGINT) AS unaligned_balance
FROM balance AS b LEFT JOIN balance2 AS b2 ON b.account = b2.account"""


@plan("audit_time_alignment", sql(TX, CREDITS, DEBITS, BALANCE, CREDITS2, DEBITS2, BALANCE2, ALIGNMENT))
def audit_time_alignment(spark, folder):
    tx = transfers(spark, folder)
    return audit.time_alignment(V.balance(tx), V.balance_with_time(tx))


@plan("audit_time_alignment_orders", sql(ORDER_TX, CREDITS, DEBITS, BALANCE, CREDITS2, DEBITS2, BALANCE2, ALIGNMENT))
def audit_time_alignment_orders(spark, folder):
    tx = order_transfers(spark, folder)
    return audit.time_alignment(V.balance(tx), V.balance_with_time(tx))


def _agreement_sql(view: str, direct: str) -> str:
    published = f"""SELECT account, {view} FROM {view}_log WHERE tick <= {SNAPSHOT_AT}
    GROUP BY account, {view} HAVING sum(diff) > 0"""
    return f"""SELECT '{view}' AS view, (SELECT count(*) FROM ({published} EXCEPT {direct}) AS extra) AS surplus,
       (SELECT count(*) FROM ({direct} EXCEPT {published}) AS absent) AS missing"""


_SEEN = f"SELECT * FROM kept WHERE epoch_us(ts) <= {SNAPSHOT_AT}"
AGREEMENT = sql(
    *KEPT_RUNS,
    CREDITS_LOG,
    DEBITS_LOG,
    BALANCE_LOG,
    f"seen AS ({_SEEN})",
    "credits AS (SELECT to_account AS account, sum(amount) AS credits FROM seen GROUP BY to_account)",
    "debits AS (SELECT from_account AS account, sum(amount) AS debits FROM seen GROUP BY from_account)",
    BALANCE,
    " UNION ALL ".join(_agreement_sql(v, f"SELECT account, {v} FROM {v}") for v in ("credits", "debits", "balance")),
)


@plan("audit_views_agree", AGREEMENT)
def audit_views_agree(spark, folder):
    """Snapshots of the histories against the views computed directly at the same tick."""
    kept = kept_transfers(spark, folder)
    steps = C.scanned_once(C.event_time_steps(kept))
    seen = V.as_of(kept, F.timestamp_micros(F.lit(SNAPSHOT_AT)))
    histories = {"credits": C.credits_changelog(steps), "debits": C.debits_changelog(steps), "balance": C.balance_changelog(steps)}
    published = [
        log.where(F.col("tick") <= SNAPSHOT_AT).select(F.lit(view).alias("view"), "account", F.col(view).alias("value"), "diff")
        for view, log in histories.items()
    ]
    # all direct views follow from one aggregate of both sides
    sides = two_sided_legs(seen).groupBy("account").agg(*[F.sum(c).alias(c) for c in C.SIDES])
    credited, debited = F.col("credit_rows") > 0, F.col("debit_rows") > 0
    values = {"credits": (credited, F.col("credit")), "debits": (debited, F.col("debit")), "balance": (credited & debited, F.col("credit") - F.col("debit"))}
    entries = [F.when(on, F.struct(F.lit(view).alias("view"), "account", value.alias("value"), F.lit(-1).alias("diff"))) for view, (on, value) in values.items()]
    direct = sides.select(F.explode(F.array(*entries)).alias("entry")).where("entry is not null").select("entry.*")
    return audit.agreement(reduce(DataFrame.unionByName, [*published, direct]), list(histories))
