"""Reads as of any tick from snapshots and runs, against adding up all rows."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tickledger.sinks.snapshots import SnapshotIndex

SCHEMA = "tick long, account int, name string, diff long"


def changelog(seed, batches):
    """Rows per batch with rising ticks: names come and go, one row is held several times, accounts may be null."""
    rng, held, tick, out = random.Random(seed), [], 0, []
    for _ in range(batches):
        rows = []
        for _ in range(rng.randint(30, 90)):
            tick += rng.randint(0, 3) if rows else 5
            if held and rng.random() < 0.4:
                rows.append((tick, *held.pop(rng.randrange(len(held))), -1))
            else:
                held.append((rng.choice([None, 0, 0, 0, rng.randrange(20)]), rng.choice(["a", "b", None])))
                rows.append((tick, *held[-1], 1))
        out.append(rows)
    return out


def expected(rows, tick):
    sums = {}
    for t, account, name, diff in rows:
        if t <= tick:
            sums[account, name] = sums.get((account, name), 0) + diff
    return {key: n for key, n in sums.items() if n > 0}


def read(index, tick):
    return {(r["account"], r["name"]): r["copies"] for r in index.as_of(tick).collect()}


def an_index(spark, folder, least_rows=40):
    return SnapshotIndex(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, least_rows)


@pytest.fixture
def batches():
    return changelog(3, 5)


def frames(spark, batches):
    return [spark.createDataFrame(rows, SCHEMA) for rows in batches]


def test_as_of_every_batch_and_after_a_restart(spark, tmp_path, batches):
    every = [row for rows in batches for row in rows]
    index = an_index(spark, tmp_path)
    for number, df in enumerate(frames(spark, batches)):
        index.append(number, df, runs=number + 1)
    # the last batch again, by a new process that finds the manifests only
    again = an_index(spark, tmp_path)
    before = index.manifest()
    assert again.append(4, frames(spark, batches)[4], runs=5) == before
    assert len(before.snapshots) >= 3 and len(before.runs) > 8
    for tick in (-1, 0, 5, every[40][0], every[150][0], before.snapshots[1].upto, before.snapshots[1].upto + 1, every[-1][0], 10**9):
        assert read(again, tick) == expected(every, tick)


def test_reads_one_snapshot_and_later_runs_only(spark, tmp_path, batches):
    index = an_index(spark, tmp_path)
    for number, df in enumerate(frames(spark, batches)):
        index.append(number, df, runs=3)
    known = index.manifest()
    tick = known.runs[-1].last
    start, runs = known.files_as_of(tick)
    files = index.as_of(tick).inputFiles()
    assert files and all(any(part.folder in f for part in [start, *runs]) for f in files)
    assert len(runs) < len(known.runs) / 2
    assert sum(r.rows for r in runs) < max(40, start.rows)
    changed = index.changes(known.runs[4].last, known.runs[6].last)
    assert all(any(r.folder in f for r in known.runs[5:7]) for f in changed.inputFiles())
    assert changed.count() == sum(r.rows for r in known.runs[5:7])


def test_ranges_of_runs_do_not_meet(spark, tmp_path, batches):
    index = an_index(spark, tmp_path)
    rows = [row for part in batches for row in part] + [(10**6, 1, "tie", 1)] * 300
    known = index.append(0, spark.createDataFrame(rows, SCHEMA), runs=8)
    assert all(a.last < b.first for a, b in zip(known.runs, known.runs[1:]))
    assert sum(r.rows for r in known.runs) == len(rows)
    assert read(index, 10**6) == expected(rows, 10**6)


def test_a_batch_that_fails_leaves_nothing_readable(spark, tmp_path, batches):
    index = an_index(spark, tmp_path)
    first, second, *_ = frames(spark, batches)
    index.append(0, first)
    before = index.manifest()
    late = spark.createDataFrame([batches[0][-1]], SCHEMA)
    with pytest.raises(ValueError, match="passed"):
        index.append(1, late)
    with pytest.raises(PySparkException, match="without a tick"):
        index.append(1, second.withColumn("tick", F.lit(None).cast("long")))
    assert index.manifest() == before and read(index, 10**9) == expected(batches[0], 10**9)
    index.append(1, second)
    assert read(index, 10**9) == expected(batches[0] + batches[1], 10**9)


def test_empty_batches(spark, tmp_path, batches):
    index = an_index(spark, tmp_path)
    empty = spark.createDataFrame([], SCHEMA)
    assert index.append(0, empty).runs == () and read(index, 5) == {} and index.changes(0, 5).count() == 0
    index.append(1, frames(spark, batches)[0])
    before = index.manifest()
    assert index.append(2, empty, runs=4) == before
