"""Keyed state, timers, the log-structured table and the line replay, over several batches and restarts."""

import os
import random
from datetime import timedelta

import pandas as pd
import pytest
from conftest import ledger, rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tickledger.operators import changelog as C
from tickledger.operators import lateness
from tickledger.operators import views as V
from tickledger.schema import TX_SCHEMA
from tickledger.sources import lines as L
from tickledger.sources import replay
from tickledger.streaming import joins, publish, timers, views
from tickledger.streaming.log_table import LogTable, newest, summing

DELAY = timedelta(seconds=5)


@pytest.fixture(scope="module")
def transfers():
    """120 transfers over 24 seconds, some more than 5 seconds behind."""
    rng = random.Random(8)
    sent = [(i, i // 5) for i in range(120)]
    order = sorted(sent, key=lambda r: (r[1] + rng.uniform(0, 9), r[0]))
    return [(i, rng.randrange(4), rng.randrange(4), rng.randrange(1, 9), s, p) for p, (i, s) in enumerate(order)]


def stream(spark, path):
    return replay.stream_files(spark, str(path), TX_SCHEMA, files_per_batch=1)


def in_two_parts(spark, data, path, run):
    """Half of the rows in two batches, a stop, then the rest with the closing row from the checkpoint."""
    half = len(data) // 2
    replay.write_replay(ledger(spark, data[:half]), str(path), 2)
    run()
    rest = ledger(spark, data[half:]).unionByName(publish.closing_row(spark))
    rest.coalesce(1).write.mode("append").parquet(str(path))
    run()


def state_rows(spark, checkpoint, variable):
    reader = spark.read.format("statestore").option("stateVarName", variable)
    return reader.load(checkpoint).count()


def test_timers_give_nets_and_leave_no_state(spark, transfers, tmp_path):
    def run():
        nets = timers.timer_nets(stream(spark, tmp_path / "in"), timedelta(seconds=20))
        publish.append_to(nets, str(tmp_path / "out"), str(tmp_path / "c"))

    in_two_parts(spark, transfers, tmp_path / "in", run)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("tick", "account", "net")) == rows(V.net_per_tick(ledger(spark, transfers)))
    assert state_rows(spark, str(tmp_path / "c"), "net") == 0


def test_late_rows_fire_timers_of_the_past(spark, transfers, tmp_path):
    def mark():
        timers.publish_marked(stream(spark, tmp_path / "in"), 7, DELAY, str(tmp_path / "m"), str(tmp_path / "mc"))

    def fire():
        lines = L.stream_lines(spark, str(tmp_path / "m" / "rows"), str(tmp_path / "c"), bytes_per_batch=1, whole_files=True)
        view = timers.late_refinements(timers.marked_rows(lines))
        publish.run_until_read(view.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))

    def run():
        mark()
        fire()

    in_two_parts(spark, transfers, tmp_path / "in", run)
    got = spark.read.parquet(str(tmp_path / "out")).select("tick", "account", "part", "net")
    expected = lateness.late_refinements(ledger(spark, transfers), 7, DELAY)
    assert rows(got) == rows(expected)
    assert got.where("part > 1").count() > 5
    assert state_rows(spark, str(tmp_path / "c"), "net") == 0


def test_lines_replay_by_name_whatever_the_file_times(spark, tmp_path):
    for n, name in enumerate(["a", "b", "c"]):
        path = tmp_path / "in" / f"{name}.txt"
        path.parent.mkdir(exist_ok=True)
        path.write_text("".join(f"{name}{i} {'x' * (i * 7 % 50)}\n" for i in range(40)))
        os.utime(path, (1000 - n, 1000 - n))  # later names are older
    seen = []

    def run(**options):
        lines = L.stream_lines(spark, str(tmp_path / "in"), str(tmp_path / "c"), bytes_per_partition=97, **options)
        publish.run_until_read(lines.writeStream.foreachBatch(lambda df, n: seen.append([r["line"] for r in df.orderBy("file", "position").collect()])), str(tmp_path / "c"))

    run(bytes_per_batch=700)
    assert len(seen) > 4
    (tmp_path / "in" / "d.txt").write_text("d0\nlast without end")
    run(bytes_per_batch=100_000)
    every = [line for batch in seen for line in batch]
    wanted = [line for name in "abcd" for line in (tmp_path / "in" / f"{name}.txt").read_text().splitlines()]
    assert every == wanted


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_every_line_belongs_to_one_part(tmp_path, step):
    text = b"one\n\ntwo two\nthree\n\n\nlast"
    (tmp_path / "f").write_bytes(text)
    found = [x for low in range(0, len(text), step) for x in L.lines_from(str(tmp_path), "f", low, min(low + step, len(text)))]
    assert [line for _, line in found] == text.split(b"\n")
    assert all(text[at:].startswith(line) for at, line in found)
    at, size = {"file": "", "byte": 0}, [("f", len(text)), ("g", 5)]
    offsets = []
    while at != {"file": "g", "byte": 5}:
        at = L.advanced(size, at, step)
        offsets.append((at["file"], at["byte"]))
    assert offsets == sorted(set(offsets))


def test_unmatched_rows_are_taken_back(spark, tmp_path):
    form = "key long, tick long, value long, ts timestamp"

    def side(name, part, data):
        frame = spark.createDataFrame(data, "key long, tick long, value long, second long").withColumn("ts", F.timestamp_seconds("second")).drop("second")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        left, right = (spark.readStream.schema(form).parquet(str(tmp_path / n)) for n in ("l", "r"))
        log = joins.outer_join_changelog(left, right, timedelta(seconds=0), timedelta(seconds=100))
        publish.append_to(log, str(tmp_path / "out"), str(tmp_path / "c"))

    side("l", 0, [(1, 0, 10, 1000), (1, 1, 11, 1000), (2, 2, 20, 1000), (3, 3, 30, 1000)])
    side("r", 0, [(2, 4, 200, 1000)])
    run()
    side("l", 1, [(4, 5, 40, 1050)])
    side("r", 1, [(1, 6, 100, 1050), (1, 7, 101, 1050)])
    run()
    side("l", 2, [(5, 8, 50, 2000)])
    side("r", 2, [(5, 9, 500, 2000)])
    run()  # the watermark passes 1000 and 1050 by more than 100 seconds
    side("l", 3, [(6, 10, 60, 2001)])
    side("r", 3, [(3, 11, 300, 2001)])
    run()
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("tick", "key", "left", F.coalesce("right", F.lit(-1)), "diff"))
    assert got == sorted(
        [(0, 1, 10, -1, 1), (1, 1, 11, -1, 1), (2, 2, 20, -1, 1), (3, 3, 30, -1, 1), (4, 2, 20, -1, -1), (4, 2, 20, 200, 1)]
        + [(5, 4, 40, -1, 1), (6, 1, 10, -1, -1), (6, 1, 11, -1, -1), (6, 1, 10, 100, 1), (6, 1, 11, 100, 1), (7, 1, 10, 101, 1), (7, 1, 11, 101, 1)]
        + [(8, 5, 50, -1, 1), (9, 5, 50, -1, -1), (9, 5, 50, 500, 1), (10, 6, 60, -1, 1)]
    )
    # what is older than 100 seconds has gone, so key 3 finds no left row any more
    assert state_rows(spark, str(tmp_path / "c"), "sides") <= 3


class OneBucket:
    """Stands in for the state of one key and its timers."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


@pytest.mark.parametrize("pairs", [1, 5, 1 << 18])
def test_buckets_join_like_single_keys(monkeypatch, pairs):
    monkeypatch.setattr(joins, "PAIRS_PER_FRAME", pairs)
    rng = random.Random(pairs)
    bucket, join = OneBucket(), joins._RetractingLeftJoin(timedelta(seconds=20))
    join.init(bucket)
    held, passed = {}, 0
    for batch in range(40):
        new = [(rng.choice([0, 0, 1, 2, 2**62 + batch // 4, -3]), rng.randrange(batch * 10, batch * 10 + 10), rng.randrange(2**61), rng.randrange(4), rng.randrange(batch * 4000, batch * 4000 + 9000)) for _ in range(rng.randrange(1, 9))]
        frames = [pd.DataFrame(part, columns=["key", "tick", "value", "flags", "millis"]) for part in (new[:3], new[3:]) if part]
        before = bucket.calls
        made = [f for f in join.handleInputRows((1,), iter(frames), None)]
        assert bucket.calls - before == 2
        got = [tuple(None if pd.isna(x) else int(x) for x in r) for f in made for r in f.itertuples(index=False)]
        wanted = []
        for key, tick, value, flags, millis in sorted(new, key=lambda r: (r[1], not r[3] & 1)):
            side, value = flags & 1, None if flags & 2 else value
            lefts, rights, until = held.get(key, ([], [], 0))
            if side:
                lefts.append(value)
                wanted += [(tick, key, value, right, 1) for right in rights or [None]]
            else:
                wanted += [(tick, key, left, None, -1) for left in lefts if not rights]
                rights.append(value)
                wanted += [(tick, key, left, value, 1) for left in lefts]
            held[key] = lefts, rights, max(until, millis + 20_000)
        order = lambda rows: sorted(rows, key=str)
        assert order(got) == order(wanted), batch
        passed = max(passed, batch * 4000 - 15_000)
        for at in [t for t in bucket.timers if t < passed]:
            list(join.handleExpiredTimer((1,), TimerValues(0, passed), ExpiredTimerInfo(at)))
            bucket.timers.remove(at)
        held = {k: v for k, v in held.items() if v[2] >= passed}
        kept = join._held(bucket.value) if bucket.value else pd.DataFrame({"key": []})
        assert sorted(set(kept["key"])) == sorted(held) and len(bucket.timers) == bool(held)


def test_left_join_state_is_in_buckets(spark, tmp_path):
    """300 keys are few state values, whatever their number; NULL keys and values are as others."""
    data = [(None if i == 7 else i, i, None if i == 9 else i, 1000) for i in range(300)]
    frame = spark.createDataFrame(data, "key long, tick long, value long, second long").withColumn("ts", F.timestamp_seconds("second")).drop("second")
    frame.write.parquet(str(tmp_path / "in"))
    rows_in = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    log = joins.outer_join_changelog(rows_in(), rows_in().withColumn("tick", F.col("tick") + 1000), timedelta(0), buckets=5)
    publish.append_to(log, str(tmp_path / "out"), str(tmp_path / "c"))
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("tick", "key", "left", "right", "diff").collect()]
    keyed = [(k, t, v) for k, t, v, _ in data]
    wanted = [x for k, t, v in keyed for x in ((t, k, v, None, 1), (t + 1000, k, v, None, -1), (t + 1000, k, v, v, 1))]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert state_rows(spark, str(tmp_path / "c"), "sides") <= 6


def test_an_account_gives_out_bounded_frames(monkeypatch):
    """What a timer fires leaves in pieces, the NULL account and values that are NULL are as before."""
    monkeypatch.setattr(joins, "ROWS_PER_FRAME", 4)
    states = [OneBucket() for _ in range(3)]
    join = joins._ChangelogJoin(lambda a, b: a - b)
    join.handle, join.waiting, join.multisets = states[0], states[0], states[1:]
    data = [(t * 1000, side, (t + 1) * (side + 1) - back, not back and t != 12, 1 - 2 * back) for t in range(12) for side in (0, 1) for back in (0,)]
    data += [(99_000, 0, 5, True, 1)]
    frame = pd.DataFrame(data, columns=["tick", "side", "value", "known", "diff"])
    assert list(join.handleInputRows((joins.NO_ACCOUNT,), iter([frame[:5], frame[5:]]), None)) == []
    made = list(join.handleExpiredTimer((joins.NO_ACCOUNT,), TimerValues(0, 50), ExpiredTimerInfo(0)))
    assert len(made) > 2 and all(f["account"].isna().all() for f in made)
    bags, wanted = ({}, {}), []
    for t in range(12):
        new = ({t + 1: 1}, {2 * t + 2: 1})
        wanted += [(t * 1000, v, n) for v, n in sorted(joins.delta_join(*bags, *new, lambda a, b: a - b).items())]
        for bag, change in zip(bags, new):
            bag.update(change)
    assert [(int(r.tick), int(r.value), int(r.diff)) for f in made for r in f.itertuples()] == wanted
    assert states[0].value[0] == [99_000] and states[0].timers >= {99}


def test_ticks_of_a_span_share_a_state_value():
    net, parts = OneBucket(), OneBucket()
    fires = timers._Refinements()
    fires.handle, fires.net, fires.parts = net, net, parts
    key, form = (3, 0), ["tick", "block", "met_mark", "delta"]
    ticks = [k * 1000 for k in range(1, 201)]
    frame = pd.DataFrame([(t, 0, 0, t) for t in ticks], columns=form)
    assert list(fires.handleInputRows(key, iter([frame[:90], frame[90:]]), None)) == []
    assert net.calls == 2 and parts.calls == 0 and net.timers == {1}
    late = pd.DataFrame([(5000, 2, 6000, 1), (5000, 1, 6000, 2), (5000, 2, 6000, 4), (500_000, 2, 6000, 9)], columns=form)
    (made,) = fires.handleInputRows(key, iter([late]), None)
    assert made[["tick", "part", "net"]].values.tolist() == [[5000, 1, 5000], [5000, 2, 2], [5000, 3, 5]]
    (made,) = fires.handleExpiredTimer(key, TimerValues(0, 101), ExpiredTimerInfo(1))
    net.timers.discard(1)
    assert made["tick"].tolist() == [t for t in ticks[:100] if t != 5000] and set(made["part"]) == {1} and net.timers == {101}
    (made,) = fires.handleExpiredTimer((timers.NO_ACCOUNT, 0), TimerValues(0, 10**6), ExpiredTimerInfo(101))
    assert len(made) == 101 and made["account"].isna().all() and net.value is None


def test_delta_rule_on_multisets():
    rng = random.Random(3)
    bag = lambda: {rng.randrange(4): rng.choice([-2, -1, 1, 2]) for _ in range(3)}

    def plus(a, b):
        both = {k: a.get(k, 0) + b.get(k, 0) for k in {*a, *b}}
        return {k: n for k, n in both.items() if n}

    def joined(a, b):
        out = {}
        for x, n in a.items():
            for y, m in b.items():
                out[x - y] = out.get(x - y, 0) + n * m
        return {k: n for k, n in out.items() if n}

    for _ in range(200):
        a, b, da, db = bag(), bag(), bag(), bag()
        change = joins.delta_join(a, b, da, db, lambda x, y: x - y)
        assert plus(joined(a, b), change) == joined(plus(a, da), plus(b, db))


def test_changelogs_join_as_ticks_close(spark, transfers, tmp_path):
    def entries(lines):
        return lines.select(F.from_json("line", joins.ENTRY).alias("e")).select("e.*")

    def run():
        steps = views.account_steps(stream(spark, tmp_path / "in"), timedelta(seconds=20), "1 second")
        publish.publish_changelogs(steps, str(tmp_path / "log"), str(tmp_path / "sc"), entries=True, names=("credits", "debits"))
        lines = L.stream_lines(spark, str(tmp_path / "log" / "entries"), str(tmp_path / "c"), bytes_per_batch=500, whole_files=True)
        view = joins.join_changelogs(entries(lines), lambda c, d: c - d, "balance")
        publish.run_until_read(view.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "c"))

    in_two_parts(spark, transfers, tmp_path / "in", run)
    publish.close_lines(spark, str(tmp_path / "log" / "entries"))
    run()
    got = spark.read.parquet(str(tmp_path / "out")).select("tick", "account", "balance", "diff")
    assert rows(got) == rows(C.balance_changelog(C.event_time_steps(ledger(spark, transfers))))


def test_retractable_sums_and_upserts_over_a_restart(spark, transfers, tmp_path):
    keyed = lambda: stream(spark, tmp_path / "in").where("id >= 0").withColumn("key", F.col("id") % 9)
    sums = joins.sums_table(spark, str(tmp_path / "sums"), "to_account", "credits", most_runs=1)
    form = T.StructType([*TX_SCHEMA.fields, T.StructField("key", T.LongType())])
    table = LogTable(spark, str(tmp_path / "table"), ("key",), form, newest(["key"], "arrival"), partitions=4, most_runs=1)

    def run():
        joins.publish_retractable_sums(joins.retractions(keyed(), "key", "arrival", "to_account", "amount"), sums, str(tmp_path / "c1"))
        publish.publish_table(views.upserted(keyed(), "key", "arrival"), table, str(tmp_path / "c2"))

    in_two_parts(spark, transfers, tmp_path / "in", run)
    latest = C.latest(ledger(spark, transfers).withColumn("key", F.col("id") % 9), "key", "arrival")
    assert rows(table.state().select(*latest.columns)) == rows(latest)
    wanted = latest.groupBy("to_account").agg(F.sum("amount").alias("credits"), F.count("*").alias("copies"))
    assert rows(sums.state().where("copies > 0").select("to_account", "credits", "copies")) == rows(wanted)


def test_a_batch_writes_only_partitions_of_its_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("n", T.LongType())])
    table = LogTable(spark, str(tmp_path / "t"), ("k",), schema, summing(["k"], ["n"]), partitions=16, most_runs=3)
    batch = lambda data: spark.createDataFrame(data, schema)
    written = {0: table.write(0, batch([(k, 1) for k in range(200)]))}
    assert written[0] == list(range(16))
    for b in range(1, 6):
        written[b] = table.write(b, batch([(7, 10), (7, 1)]))
        assert len(written[b]) == 1 and len(os.listdir(tmp_path / "t" / "runs" / f"batch={b:012d}")) - 1 <= 2
    own = written[1][0]
    before = table.manifest()
    assert len(before[own]) <= 3 and all(len(folders) == 1 for part, folders in before.items() if part != own)
    assert {r["k"]: r["n"] for r in table.state().collect()} == {k: 1 + 55 * (k == 7) for k in range(200)}
    # a batch that runs again overwrites itself, a reader as of an earlier batch sees that one
    table.write(5, batch([(7, 10), (7, 1)]))
    assert table.manifest() == before
    assert table.state(batch([(7, 0)]), before=3).first()["n"] == 1 + 22
    assert table.vacuum() and not table.unused()
    assert table.state(batch([(7, 0), (8, 0)])).agg(F.sum("n")).first()[0] == 57


def test_accounts_of_a_batch_only(spark, tmp_path):
    """A batch about two accounts reads and writes their partitions, and the total still counts all accounts."""
    data = [(i, i % 40, (i + 1) % 40, 5, i // 10, i) for i in range(80)] + [(80 + i, 1, 2, 3, 20 + i, 80 + i) for i in range(6)]
    (tmp_path / "in").mkdir()
    for n, part in enumerate([data[:80], data[80:]]):
        frame = ledger(spark, part)
        (frame if n == 0 else frame.unionByName(publish.closing_row(spark))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        steps = views.account_steps(stream(spark, tmp_path / "in"), timedelta(seconds=0), "1 second")
        publish.publish_changelogs(steps, str(tmp_path / "out"), str(tmp_path / "c"), partitions=32)
    table = publish.accounts_table(spark, str(tmp_path / "out"), partitions=32)
    last = table.batches()[-1]
    assert len([n for n in os.listdir(tmp_path / "out" / "accounts" / "runs" / f"batch={last:012d}") if n.startswith("table_part")]) <= 12
    batch = C.event_time_steps(ledger(spark, data))
    for name, view in publish.VIEWS.items():
        assert rows(publish.read_batches(spark, str(tmp_path / "out" / name)).drop("batch")) == rows(view(batch)), name
