import random
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import ledger, rows
from pyspark.sql import functions as F

from tickledger.operators import changelog as C
from tickledger.operators import lateness
from tickledger.operators import views as V
from tickledger.plans import PLANS
from tickledger.schema import TX_SCHEMA
from tickledger.sources import replay
from tickledger.sources import transactions as S
from tickledger.streaming import publish, views

GRANULE = "1 second"


@pytest.fixture(scope="module")
def transfers():
    """200 transfers over 40 seconds, none more than 3 seconds behind."""
    rng = random.Random(8)
    sent = [(i, i // 5) for i in range(200)]
    order = sorted(sent, key=lambda r: (r[1] + rng.uniform(0, 3), r[0]))
    return [(i, rng.randrange(4), rng.randrange(4), rng.randrange(1, 9), s, p) for p, (i, s) in enumerate(order)]


def stream(spark, path, files_per_batch=1):
    return replay.stream_files(spark, str(path), TX_SCHEMA, files_per_batch=files_per_batch)


def write_files(spark, data, path, files):
    replay.write_replay(ledger(spark, data).unionByName(publish.closing_row(spark)), str(path), files)


def published(spark, view, path, name="rows"):
    publish.append_to(view, f"{path}/{name}", f"{path}/{name}-checkpoint")
    return spark.read.schema(view.schema).parquet(f"{path}/{name}")


def test_replay_takes_files_in_arrival_order(spark, transfers, tmp_path):
    write_files(spark, transfers, tmp_path / "in", 4)
    seen = []
    query = stream(spark, tmp_path / "in").writeStream.foreachBatch(
        lambda df, n: seen.append(tuple(df.agg(F.min("arrival"), F.max("arrival")).first()))
    )
    publish.run_available(query, str(tmp_path / "c"))
    assert len(seen) == 4 and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))


def test_closed_ticks_equal_the_batch_view(spark, transfers, tmp_path):
    write_files(spark, transfers, tmp_path / "in", 4)
    nets = published(spark, views.net_per_tick(stream(spark, tmp_path / "in"), timedelta(seconds=5), GRANULE), tmp_path)
    assert rows(nets) == rows(V.net_per_tick(ledger(spark, transfers)))


def test_late_rows_are_dropped_once_their_tick_is_closed(spark, tmp_path):
    data = [(i, 0, 1, 1, i, i) for i in range(30)] + [(90, 0, 1, 7, 2, 30), (91, 0, 1, 1, 30, 31)]
    for n, part in enumerate([data[:15], data[15:30], data[30:], []]):
        part_df = ledger(spark, part) if part else publish.closing_row(spark)
        part_df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{n}"))
        Path(tmp_path / "in").mkdir(exist_ok=True)
        file = next(Path(tmp_path / f"part{n}").glob("*.parquet"))
        (tmp_path / "in" / f"{n}.parquet").write_bytes(file.read_bytes())
    replay.stamp_in_name_order(spark, str(tmp_path / "in"))
    nets = published(spark, views.net_per_tick(stream(spark, tmp_path / "in"), timedelta(seconds=5), GRANULE), tmp_path)
    accepted = ledger(spark, [r for r in data if r[0] != 90])
    assert rows(nets) == rows(V.net_per_tick(accepted))


def test_chained_totals_are_zero(spark, transfers, tmp_path):
    write_files(spark, transfers, tmp_path / "in", 3)
    totals = published(spark, views.total_per_tick(stream(spark, tmp_path / "in"), timedelta(seconds=5), GRANULE), tmp_path)
    assert totals.count() == 40 and totals.where("total <> 0").count() == 0


def test_open_ticks_are_not_published(spark, transfers, tmp_path):
    replay.write_replay(ledger(spark, transfers), str(tmp_path / "in"), 3)
    nets = published(spark, views.net_per_tick(stream(spark, tmp_path / "in"), timedelta(seconds=5), GRANULE), tmp_path)
    last = nets.agg(F.max("tick")).first()[0]
    full = V.net_per_tick(ledger(spark, transfers))
    assert 0 < nets.count() < full.count()
    assert rows(nets) == rows(full.where(F.col("tick") <= last))


def test_histories_from_one_query_equal_the_batch_histories(spark, transfers, tmp_path):
    write_files(spark, transfers, tmp_path / "in", 4)
    steps = views.account_steps(stream(spark, tmp_path / "in"), timedelta(seconds=5), GRANULE)
    query = publish.publish_changelogs(steps, str(tmp_path / "out"), str(tmp_path / "c"))
    assert len(publish.published_batches(spark, str(tmp_path / "out" / "balance"))) > 1
    batch = C.event_time_steps(ledger(spark, transfers))
    for name, view in publish.VIEWS.items():
        got = publish.read_batches(spark, str(tmp_path / "out" / name)).drop("batch")
        assert rows(got) == rows(view(batch)), name
    marks = [w for _, w in publish.watermark_progress(query)]
    assert marks == sorted(marks) and len(set(marks)) > 2


def test_restart_continues_from_the_checkpoint(spark, transfers, tmp_path):
    half = len(transfers) // 2
    folder = tmp_path / "in"
    replay.write_replay(ledger(spark, transfers[:half]), str(folder), 2)
    steps = lambda: views.account_steps(stream(spark, folder), timedelta(seconds=5), GRANULE)
    publish.publish_changelogs(steps(), str(tmp_path / "out"), str(tmp_path / "c"))
    before = publish.published_batches(spark, str(tmp_path / "out" / "balance"))
    rest = ledger(spark, transfers[half:]).unionByName(publish.closing_row(spark))
    rest.coalesce(1).write.mode("append").parquet(str(folder))
    publish.publish_changelogs(steps(), str(tmp_path / "out"), str(tmp_path / "c"))
    after = publish.published_batches(spark, str(tmp_path / "out" / "balance"))
    assert set(before) < set(after)
    got = publish.read_batches(spark, str(tmp_path / "out" / "balance")).drop("batch")
    assert rows(got) == rows(C.balance_changelog(C.event_time_steps(ledger(spark, transfers))))


def test_eager_states_and_their_history(spark, transfers, tmp_path):
    replay.write_replay(ledger(spark, transfers), str(tmp_path / "in"), 3)
    eager = views.eager_accounts(stream(spark, tmp_path / "in"))
    publish.publish_states(eager, str(tmp_path / "states"), str(tmp_path / "c"))
    states = publish.read_batches(spark, str(tmp_path / "states"))
    on = (F.col("credit_rows") > 0) & (F.col("debit_rows") > 0)
    versions = states.withColumn("balance", F.col("credit") - F.col("debit"))
    log = C.changelog_of_versions(versions, ["account"], "balance", on, tick="batch")
    end = C.snapshot_as_of(log, ["account", "balance"], 99)
    assert rows(end.drop("copies")) == rows(V.balance(ledger(spark, transfers)))


def test_upserts_keep_the_newest_row(spark, transfers, tmp_path):
    replay.write_replay(ledger(spark, transfers), str(tmp_path / "in"), 3)
    keyed = stream(spark, tmp_path / "in").withColumn("key", F.col("id") % 7)
    publish.publish_states(views.upserted(keyed, "key", "arrival"), str(tmp_path / "s"), str(tmp_path / "c"))
    newest = C.latest(publish.read_batches(spark, str(tmp_path / "s")), "key", "batch").drop("batch")
    batch = C.latest(ledger(spark, transfers).withColumn("key", F.col("id") % 7), "key", "arrival")
    assert rows(newest) == rows(batch.select(*newest.columns))


def test_self_join_takes_back_the_unmatched_row(spark, six, tmp_path):
    replay.write_replay(six, str(tmp_path / "left"), 2)
    replay.write_replay(six.where("id < 100").orderBy("arrival"), str(tmp_path / "right"), 3)
    sides = views.self_join_sides(stream(spark, tmp_path / "left"), stream(spark, tmp_path / "right"))
    publish.publish_states(sides, str(tmp_path / "s"), str(tmp_path / "c"))
    states = publish.read_batches(spark, str(tmp_path / "s"))
    versions = states.withColumn("other_id", F.when(F.col("in_right"), F.col("id")))
    log = C.changelog_of_versions(versions, ["id"], "other_id", F.col("in_left"), tick="batch")
    end = C.snapshot_as_of(log, ["id", "other_id"], 99)
    assert rows(end.drop("copies")) == [(i, i) for i in range(6)]
    assert log.where("other_id is null and diff = 1").count() == log.where("other_id is null and diff = -1").count() > 0


def test_left_join_with_time_needs_no_wait_for_matches(spark, six, tmp_path):
    replay.write_replay(six, str(tmp_path / "in"), 1)
    right = stream(spark, tmp_path / "in").where("id <> 2")
    joined = views.outer_join_with_time(stream(spark, tmp_path / "in"), right, timedelta(seconds=0))
    got = published(spark, joined, tmp_path)
    assert [r for r in rows(got.where("other_id is not null"))] == [(0, 0), (1, 1), (3, 3), (4, 4), (5, 5)]


def test_one_batch_stream_closes_with_the_closing_row(spark, transfers, tmp_path):
    ledger(spark, transfers).write.parquet(str(tmp_path / "in"))
    closed = publish.closed_stream(stream(spark, tmp_path / "in", files_per_batch=None))
    nets = published(spark, views.net_per_tick(closed, timedelta(seconds=5), GRANULE), tmp_path)
    assert rows(nets) == rows(V.net_per_tick(ledger(spark, transfers)))


def test_text_and_message_sinks(spark, six, tmp_path):
    replay.write_replay(six, str(tmp_path / "in"), 2)
    source = stream(spark, tmp_path / "in")
    lines = source.select(F.concat_ws(" ", F.lit("insert"), F.col("id").cast("string")).alias("value"))
    publish.append_to(lines, str(tmp_path / "text"), str(tmp_path / "c1"), form="text")
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).orderBy("value").collect()] == [f"insert {i}" for i in range(6)]
    publish.append_messages(source.select("id", "amount"), "id", str(tmp_path / "m"), str(tmp_path / "c2"))
    assert rows(spark.read.parquet(str(tmp_path / "m")))[0] == ("0", '{"id":0,"amount":10}')


def test_streaming_reader_is_strict(spark, six, tmp_path):
    six.select(S.json_document().alias("line")).coalesce(1).write.text(str(tmp_path / "in"))
    got = published(spark, S.stream_json_lines(spark, str(tmp_path / "in"), files_per_batch=1), tmp_path)
    assert rows(got) == rows(six.drop("arrival"))
    (tmp_path / "in" / "bad.txt").write_text('{"id": 1}\n')
    with pytest.raises(Exception, match="missing field"):
        published(spark, S.stream_json_lines(spark, str(tmp_path / "in")), tmp_path, "strict")


FOLDER_QUERIES = [
    "stream_pass_through", "stream_net_per_tick", "total_finalized", "stream_balance_per_tick_join",
    "stream_outer_join_with_time", "stream_messages", "stream_net_messages",
]


@pytest.fixture(scope="module")
def events_as_folder(spark, tmp_path_factory):
    """The stored events as a folder of part files, the way Spark writes a table."""
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(5).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", FOLDER_QUERIES)
def test_a_folder_table_streams_like_a_single_file(spark, events_as_folder, name):
    stored, single = (rows(PLANS[name].run(spark, f)) for f in (events_as_folder, "/root/testdata/sf0.001"))
    assert stored == single and len(stored) > 0


def test_reading_nothing_of_a_table_with_rows_is_an_error(spark, events_as_folder, monkeypatch):
    def nothing(session, folder, name, schema, **_):
        return session.readStream.schema(schema).option("pathGlobFilter", "none").parquet(folder)

    monkeypatch.setattr(replay, "stream_table", nothing)
    with pytest.raises(RuntimeError, match="no rows were read"):
        PLANS["stream_pass_through"].run(spark, events_as_folder)


def test_exact_late_rule_over_batches(spark, tmp_path):
    rng = random.Random(3)
    data = [(i, rng.randrange(4), rng.randrange(4), 1, rng.randrange(60), i) for i in range(300)]
    write_files(spark, data, tmp_path / "in", 5)
    publish.publish_accepted(stream(spark, tmp_path / "in").where("id >= 0"), timedelta(seconds=5), str(tmp_path / "out"), str(tmp_path / "c"))
    got = publish.read_batches(spark, str(tmp_path / "out" / "rows"))
    expected = lateness.accepted(ledger(spark, data), timedelta(seconds=5))
    assert rows(got.drop("batch")) == rows(expected) and 0 < expected.count() < 300
    assert got.select("batch").distinct().count() > 1


def test_long_replays_have_more_batches(spark, transfers, tmp_path):
    rows_ = ledger(spark, transfers)
    assert replay.write_replay(rows_, str(tmp_path / "in"), 2, rows_per_file=10, most_files=4) == 4
    assert len(list((tmp_path / "in").glob("*.parquet"))) == 20  # five batches instead of two


def test_batches_hold_the_rows_of_their_number(spark, transfers, tmp_path):
    each = replay.write_batches(ledger(spark, transfers), F.col("id") % 3, 3, str(tmp_path / "in"), rows_per_file=40)
    assert each == 2
    seen = []
    reader = stream(spark, tmp_path / "in", each)
    query = reader.writeStream.foreachBatch(lambda df, n: seen.append({r[0] for r in df.selectExpr("id % 3").collect()}))
    publish.run_available(query, str(tmp_path / "c"))
    assert seen == [{0}, {1}, {2}]


def test_the_gated_stream_drops_late_rows_in_every_table():
    from check_against_sql import connect

    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        text = PLANS["stream_net_per_tick_late"].sql
        kept, sent = (connect(folder).execute(f"{text[: text.rindex('SELECT tick, account')]} SELECT count(*) FROM {name}").fetchone()[0] for name in ("on_time", "tx"))
        assert 0 < kept < sent
