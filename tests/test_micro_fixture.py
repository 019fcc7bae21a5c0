"""Six transfers worked out by hand, with a five second late rule."""

from datetime import timedelta

import pytest
from conftest import at, rows, tick
from pyspark.sql import functions as F

from tickledger.operators import changelog as C
from tickledger.operators import lateness, views

DELAY = timedelta(seconds=5)


def seconds(df, column="tick"):
    return df.withColumn(column, ((F.col(column) - tick(0)) / 1_000_000).cast("int"))


@pytest.fixture
def kept(six):
    return lateness.accepted(six, DELAY)


def test_late_split(six):
    split = lateness.late_split(six, DELAY).orderBy("id").collect()
    assert [r.kept for r in split] == [True, True, True, True, False, True]
    since = [r.watermark.timestamp() - at(0).timestamp() for r in split]
    assert since == [-5, -4, 3, 3, 3, 4]


def test_accepted_keeps_equality(kept):
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2, 3, 5]


def test_snapshot_views(kept):
    assert rows(views.credits(kept)) == [(0, 7), (1, 14), (2, 6)]
    assert rows(views.debits(kept)) == [(0, 11), (1, 5), (2, 11)]
    assert rows(views.balance(kept)) == [(0, -4), (1, 9), (2, -5)]
    assert rows(views.total(views.balance(kept))) == [(0,)]


def test_balance_changelog(kept, six):
    log = C.balance_changelog(C.event_time_steps(kept))
    assert rows(seconds(log)) == sorted(
        [(1, 1, 5, 1), (8, 0, -4, 1), (8, 2, -1, 1), (9, 1, 5, -1), (9, 1, 9, 1), (9, 2, -1, -1), (9, 2, -5, 1)]
    )
    everything = C.balance_changelog(C.event_time_steps(six))
    assert rows(seconds(everything)) == sorted(
        [(1, 1, 5, 1), (2, 0, -8, 1), (2, 1, 5, -1), (2, 1, 3, 1), (3, 0, -8, -1), (3, 0, -9, 1), (8, 0, -9, -1)]
        + [(8, 0, -2, 1), (8, 2, -1, 1), (9, 1, 3, -1), (9, 1, 7, 1), (9, 2, -1, -1), (9, 2, -5, 1)]
    )


def test_totals(kept, six):
    assert rows(seconds(C.total_by_tick(C.event_time_steps(kept)))) == [(1, 5), (8, 0), (9, 0)]
    assert rows(seconds(C.total_by_tick(C.event_time_steps(six)))) == [(1, 5), (2, -5), (3, -6), (8, 0), (9, 0)]
    log = C.total_changelog(C.event_time_steps(kept))
    assert rows(seconds(log)) == [(1, 5, 1), (8, 0, 1), (8, 5, -1)]


def test_progress(six):
    assert [w for (w,) in rows(seconds(lateness.progress_rows(six, DELAY), "watermark"))] == [-5, -4, 3, 4]


def test_empty_input(six):
    nothing = six.where("false")
    assert rows(views.total(views.balance(nothing))) == [(None,)]
    assert rows(views.total_by_constant(views.balance(nothing))) == []
    assert rows(C.balance_changelog(C.event_time_steps(nothing))) == []
    assert rows(lateness.accepted(nothing, DELAY)) == []
