import random

import pytest
from conftest import ledger, rows
from pyspark.sql import functions as F

from tickledger.operators import audit, views
from tickledger.operators import changelog as C
from tickledger.operators.scan import plan_layout


@pytest.fixture(scope="module")
def busy():
    """400 transfers; account 0 takes part in most of them, some pay themselves."""
    rng = random.Random(11)
    pick = lambda: 0 if rng.random() < 0.6 else rng.randrange(1, 8)
    order = rng.sample(range(1000), 400)
    return [(i, pick(), pick(), rng.randrange(0, 9), rng.randrange(40), p) for i, p in enumerate(order)]


def split_steps(steps):
    """The same steps scanned in pieces."""
    return C.Steps(steps.rows, plan_layout(steps.rows, "tick", ["account"], buckets=6))


def replayed(changelog, columns):
    """Applies a changelog tick by tick; every row must be inserted before it is deleted."""
    states, bag = {}, {}
    for r in sorted(changelog.collect(), key=lambda r: (r.tick, r.diff)):
        row = tuple(r[c] for c in columns)
        bag[row] = bag.get(row, 0) + r.diff
        assert r.diff in (-1, 1) and bag[row] >= 0
        states[r.tick] = {k for k, n in bag.items() if n}
    return states


def balances(transfers):
    credit, debit = {}, {}
    for _, sender, receiver, amount, *_ in transfers:
        credit[receiver] = credit.get(receiver, 0) + amount
        debit[sender] = debit.get(sender, 0) + amount
    return {(a, credit[a] - debit[a]) for a in credit.keys() & debit.keys()}


@pytest.mark.parametrize("by", ["event", "arrival"])
def test_balance_history_equals_the_view_at_every_tick(spark, busy, by):
    tx = ledger(spark, busy)
    steps = C.event_time_steps(tx) if by == "event" else C.arrival_steps(tx)
    states = replayed(C.balance_changelog(split_steps(steps)), ["account", "balance"])
    from conftest import tick

    place = (lambda r: tick(r[4])) if by == "event" else (lambda r: r[5])
    current = set()
    for t in sorted({place(r) for r in busy}):
        current = states.get(t, current)
        assert current == balances([r for r in busy if place(r) <= t])


def test_eager_history_shows_half_transfers(spark, busy):
    steps = split_steps(C.eager_steps(ledger(spark, busy)))
    totals = C.total_by_tick(steps)
    assert audit.zero_sum(totals).first().nonzero > 50
    settled = C.arrival_steps(ledger(spark, busy))
    assert audit.zero_sum_once_settled(C.total_by_tick(settled), settled).first().nonzero == 0
    assert audit.zero_sum(C.union_total_by_tick(settled)).first().nonzero == 0


def test_input_order_and_partitioning_do_not_matter(spark, busy):
    tx = ledger(spark, busy)
    mixed = ledger(spark, random.Random(1).sample(busy, len(busy))).repartition(7, "amount")
    for view in (C.credits_changelog, C.debits_changelog, C.balance_changelog, C.total_changelog):
        assert rows(view(C.event_time_steps(tx))) == rows(view(split_steps(C.event_time_steps(mixed))))


def test_join_of_changelogs_equals_the_direct_history(spark, busy):
    for steps in (C.event_time_steps(ledger(spark, busy)), C.eager_steps(ledger(spark, busy))):
        steps = split_steps(steps)
        joined = C.join_changelogs(
            C.credits_changelog(steps),
            C.debits_changelog(steps),
            "account",
            "credits",
            "debits",
            lambda a, b: a - b,
            "balance",
            layout=steps.layout,
        )
        assert rows(joined) == rows(C.balance_changelog(steps))


def test_join_of_changelogs_follows_deletes(spark):
    schema = "tick bigint, k int, v bigint, diff int"
    left = spark.createDataFrame([(1, 7, 10, 1), (4, 7, 10, -1), (6, 7, 12, 1)], schema)
    right = spark.createDataFrame([(2, 7, 3, 1), (5, 7, 3, -1), (5, 7, 4, 1), (6, 7, 4, -1), (6, 7, 5, 1)], schema)
    inner = C.join_changelogs(left, right, "k", "v", "v", lambda a, b: a * 100 + b, "p")
    assert rows(inner) == [(2, 7, 1003, 1), (4, 7, 1003, -1), (6, 7, 1205, 1)]
    outer = C.join_changelogs(left, right, "k", "v", "v", lambda a, b: a * 100 + F.coalesce(b, F.lit(0)), "p", how="left")
    assert rows(outer) == [(1, 7, 1000, 1), (2, 7, 1000, -1), (2, 7, 1003, 1), (4, 7, 1003, -1), (6, 7, 1205, 1)]


def test_self_join_retracts_the_unmatched_row(six):
    log = C.self_join_changelog(six)
    first = [(r.tick, r.other_id, r.diff) for r in log.where("id = 3").collect()]
    assert sorted(first, key=str) == sorted([(6, None, 1), (7, None, -1), (7, 3, 1)], key=str)
    found = audit.unmatched(log).first()
    assert (found.outputs, found.unmatched_outputs, found.unmatched_at_end) == (12, 6, 0)


def test_consolidate_and_weighted_sum(spark):
    log = spark.createDataFrame(
        [(1, "a", 5, 1), (1, "a", 5, -1), (2, "a", 5, 3), (2, "b", 4, 1), (3, "b", 4, -1)],
        "tick bigint, k string, v bigint, diff int",
    )
    assert rows(C.consolidate(log, ["k", "v"])) == [(2, "a", 5, 3), (2, "b", 4, 1), (3, "b", 4, -1)]
    assert rows(C.weighted_sum(log, "k", "v", "total")) == [("a", 15)]


def test_snapshot_and_copies_of_a_hot_row(spark):
    log = spark.range(1000).select(
        F.col("id").alias("tick"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("v"), F.lit(1).alias("diff")
    )
    at = C.snapshot_as_of(log, ["v"], 899)
    assert at.where("v = 0").first().copies == 601
    written = C.repeat_copies(at, ["v"], step=100)
    assert written.count() == 900 and written.where("v = 0").count() == 601


def test_retractions_give_the_latest_rows(spark):
    rng = random.Random(2)
    data = [(0 if rng.random() < 0.5 else rng.randrange(1, 30), p, rng.randrange(4), rng.randrange(50)) for p in range(500)]
    upserts = spark.createDataFrame(data, "key bigint, arrival bigint, to_account int, amount bigint").repartition(3)
    newest = {}
    for key, _, account, amount in data:
        newest[key] = (account, amount)
    want = {}
    for account, amount in newest.values():
        want[account] = want.get(account, 0) + amount
    changes = C.retractions(upserts, "key", "arrival", ["to_account", "amount"])
    assert dict(rows(C.weighted_sum(changes, "to_account", "amount", "s"))) == want
    assert rows(C.latest(upserts, "key", "arrival").select("key", "to_account", "amount")) == sorted(
        (k, a, m) for k, (a, m) in newest.items()
    )


def test_views_agree_with_snapshots_and_the_check_can_fail(spark, busy):
    tx = ledger(spark, busy)
    log = C.balance_changelog(C.event_time_steps(tx))
    last = log.agg(F.max("tick")).first()[0]
    published = C.snapshot_as_of(log, ["account", "balance"], last)
    assert audit.differences(published, views.balance(tx), ["account", "balance"]).count() == 0
    off = views.balance(tx).withColumn("balance", F.col("balance") + (F.col("account") == 0).cast("int"))
    assert sorted(r.surplus for r in audit.differences(published, off, ["account", "balance"]).collect()) == [-1, 1]


def test_balance_forms_and_time_alignment(spark, busy):
    tx = ledger(spark, busy)
    assert rows(views.balance(tx)) == rows(views.balance_by_join(views.credits(tx), views.debits(tx)))
    c2, d2 = views.credits_with_time(tx), views.debits_with_time(tx)
    joined = c2.join(d2, ["account", "ts"]).selectExpr("account", "credits - debits as balance", "ts")
    assert rows(views.balance_with_time(tx)) == rows(joined)
    counts = audit.time_alignment(views.balance(tx), views.balance_with_time(tx)).first()
    assert counts.aligned == joined.count() and counts.accounts == counts.aligned + counts.unaligned
