"""Two-phase sink, watermark lines, observed audits and state read-back."""

import os
import random
from datetime import timedelta

import pytest
from conftest import ledger, rows
from pyspark.sql import functions as F

from tickledger.functions.legs import two_sided_legs
from tickledger.operators import audit
from tickledger.operators import changelog as C
from tickledger.schema import TX_SCHEMA
from tickledger.sinks import committed
from tickledger.sources import replay
from tickledger.streaming import progress, publish, views


@pytest.fixture(scope="module")
def transfers():
    rng = random.Random(2)
    return [(i, rng.randrange(5), rng.randrange(5), rng.randrange(1, 9), i // 4, i) for i in range(80)]


def stream(spark, path):
    return replay.stream_files(spark, str(path), TX_SCHEMA, files_per_batch=1)


def test_a_failed_batch_leaves_nothing_readable(spark, transfers, tmp_path):
    replay.write_replay(ledger(spark, transfers), str(tmp_path / "in"), 2)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run(broken):
        fails = F.when((F.col("id") >= broken) & (F.col("amount") > 0), F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string"))
        lines = stream(spark, tmp_path / "in").repartition(3).select(fails.alias("line"))
        publish.run_available(committed.write_stream(lines, out), checkpoint)

    with pytest.raises(Exception, match="broken"):
        run(broken=60)
    assert list(committed.committed(out)) == [0]
    first = rows(committed.read(spark, out))
    assert 0 < len(first) <= 60 and all(int(r[0]) < 60 for r in first)
    run(broken=1000)
    assert sorted(int(r[0]) for r in rows(committed.read(spark, out))) == list(range(80))
    named = {name for files in committed.committed(out).values() for name in files}
    assert committed.committed(str(tmp_path / "none")) == {} and len(named) <= len(os.listdir(f"{out}/data"))


def test_watermark_lines_come_in_order_and_cover_closed_ticks(spark, transfers, tmp_path):
    replay.write_replay(ledger(spark, transfers).unionByName(publish.closing_row(spark)), str(tmp_path / "in"), 4)
    told = []
    listener = progress.ProgressLines(told.append)
    spark.streams.addListener(listener)
    try:
        nets = views.net_per_tick(stream(spark, tmp_path / "in"), timedelta(seconds=2), "1 second")
        query = publish.append_to(nets, str(tmp_path / "out"), str(tmp_path / "c"))
        marks = listener.marks(query)
    finally:
        spark.streams.removeListener(listener)
    assert len(marks) > 2 and marks == sorted(set(marks))
    assert told == [progress.line_of(at) for _, at in marks]
    last = spark.read.parquet(str(tmp_path / "out")).agg(F.max("tick")).first()[0]
    assert last < marks[-1][1]


def test_audit_of_the_publishing_pass(spark, transfers, tmp_path):
    """Observed per batch and added up: the audit over the whole history, also where totals are off."""
    replay.write_replay(ledger(spark, transfers).unionByName(publish.closing_row(spark)), str(tmp_path / "in"), 3)
    steps = views.account_steps(stream(spark, tmp_path / "in"), timedelta(seconds=5), "1 second")
    publish.publish_changelogs(steps, str(tmp_path / "out"), str(tmp_path / "c"), audit=True, names=("total",))
    got = progress.zero_sum_of(publish.read_batches(spark, str(tmp_path / "out" / "audit")))
    assert len(publish.published_batches(spark, str(tmp_path / "out" / "audit"))) > 1
    expected = audit.zero_sum(C.total_by_tick(C.event_time_steps(ledger(spark, transfers))))
    assert rows(got) == rows(expected) and expected.first()["nonzero"] > 0


def test_state_equals_what_was_published_after_a_restart(spark, transfers, tmp_path):
    for part in (transfers[:30], transfers[30:]):
        ledger(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        publish.publish_states(views.eager_accounts(stream(spark, tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "c"))
    published = C.latest(publish.read_batches(spark, str(tmp_path / "s")), "account", "batch").drop("batch")
    state = progress.account_sides(spark, str(tmp_path / "c"))
    assert rows(state) == rows(published.select(*state.columns))
    sides = two_sided_legs(ledger(spark, transfers)).groupBy("account").agg(*[F.sum(c).alias(c) for c in C.SIDES])
    assert rows(state) == rows(sides)
