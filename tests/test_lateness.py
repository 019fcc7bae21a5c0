import random
from datetime import timedelta

import pytest
from conftest import ledger, rows, tick
from pyspark.sql import functions as F

from tickledger.operators import lateness
from tickledger.operators.scan import plan_layout


@pytest.fixture(scope="module")
def jumbled():
    """Delayed transfers; a third of them carry one and the same event time."""
    rng = random.Random(3)
    sent = [(i, 20 if rng.random() < 0.33 else i // 10) for i in range(600)]
    order = sorted(sent, key=lambda r: (r[1] + rng.uniform(0, 10), r[0]))
    return [(i, rng.randrange(5), rng.randrange(5), rng.randrange(1, 9), s, p) for p, (i, s) in enumerate(order)]


def kept_by_loop(data, delay):
    high, kept, marks = None, [], []
    for row in sorted(data, key=lambda r: (r[5], r[0])):
        high = row[4] if high is None else max(high, row[4])
        marks.append(high - delay)
        if row[4] >= high - delay:
            kept.append(row[0])
    return sorted(kept), sorted(set(marks))


@pytest.mark.parametrize("delay", [0, 2, 5, 30])
def test_both_forms_of_the_late_rule_match_a_loop(spark, jumbled, delay):
    tx = ledger(spark, jumbled).repartition(3)
    kept, marks = kept_by_loop(jumbled, delay)
    wait = timedelta(seconds=delay)
    split = lateness.late_split(tx, wait, plan_layout(tx, "arrival", buckets=6))
    assert sorted(r.id for r in split.where("kept").collect()) == kept
    assert sorted(r.id for r in lateness.accepted(tx, wait).collect()) == kept
    assert [w for (w,) in rows(lateness.progress_rows(tx, wait))] == [tick(m) for m in marks]


def test_nothing_is_late_when_the_rule_is_wide(spark, jumbled):
    tx = ledger(spark, jumbled)
    assert lateness.accepted(tx, timedelta(hours=1)).count() == len(jumbled)


def test_periodic_watermark_never_steps_back(spark, jumbled):
    tx = ledger(spark, jumbled)
    got = rows(lateness.periodic_watermark(tx, 7, timedelta(seconds=5)))
    ordered = sorted(jumbled, key=lambda r: r[5])
    want, high = [], None
    for n in range(7, len(ordered) + 1, 7):
        mark = tick(ordered[n - 1][4] - 5)
        high = mark if high is None else max(high, mark)
        want.append((n, high))
    assert got == want


def test_row_count_starts_anew_in_each_file(spark, jumbled):
    tx = ledger(spark, jumbled).withColumn("file", F.floor(F.col("arrival") / 250).cast("int"))
    got = rows(lateness.periodic_watermark_per_file(tx, 7, timedelta(seconds=5), "file"))
    ordered = sorted(jumbled, key=lambda r: r[5])
    want, high = [], None
    for file in range(3):
        part = ordered[250 * file : 250 * (file + 1)]
        for n in range(7, len(part) + 1, 7):
            mark = tick(part[n - 1][4] - 5)
            high = mark if high is None else max(high, mark)
            want.append((file, n, high))
    assert got == want


def test_late_refinements_match_a_timer_simulation(spark, jumbled):
    every, delay = 7, 5
    state, fired, high = {}, {}, None

    def fire(up_to):
        for key in [k for k in state if up_to is None or k[0] <= up_to]:
            fired.setdefault(key, []).append(state.pop(key))

    for n, (_, sender, receiver, amount, s, _) in enumerate(sorted(jumbled, key=lambda r: r[5]), 1):
        for account, delta in ((receiver, amount), (sender, -amount)):
            state[(s, account)] = state.get((s, account), 0) + delta
        if n % every == 0:
            high = s - delay if high is None else max(high, s - delay)
            fire(high)
    fire(None)
    want = sorted((tick(s), a, part, net) for (s, a), nets in fired.items() for part, net in enumerate(nets, 1))
    got = rows(lateness.late_refinements(ledger(spark, jumbled), every, timedelta(seconds=delay)))
    assert got == want
    assert max(part for _, _, part, _ in got) > 1


def test_step_lookup_is_strict_or_not(spark):
    marks = spark.createDataFrame([(10, 5), (20, 3), (30, 9)], "at bigint, n bigint")
    probes = spark.createDataFrame([(p,) for p in (5, 10, 25, 30, 31)], "at bigint")
    strict = lateness.least_at_or_after(marks, probes, "n", strict=True)
    assert rows(strict.withColumn("n", F.coalesce("n", F.lit(-1)))) == [(5, 3), (10, 3), (25, 9), (30, -1), (31, -1)]
    loose = lateness.least_at_or_after(marks, probes, "n", strict=False)
    assert rows(loose.withColumn("n", F.coalesce("n", F.lit(-1)))) == [(5, 3), (10, 3), (25, 9), (30, 9), (31, -1)]
