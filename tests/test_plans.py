"""The plans the queries should get: scans, shuffles, pushdown."""

import re
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from tickledger.operators import changelog as C
from tickledger.operators import lateness, scan
from tickledger.operators import views as V
from tickledger.operators.scan import plan_layout
from tickledger.sources import generate


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ledger") / "tx")
    generate.original(spark.range(20_000), F.lit(20_000)).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    """20,000 rows in 32 buckets, as a large table would have."""
    monkeypatch.setattr(scan, "ROWS_PER_BUCKET", 625)


@pytest.fixture
def shuffled_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def before_run(df):
    return df._jdf.queryExecution().executedPlan().toString()


def after_run(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_balance_is_one_scan_and_one_shuffle(stored):
    plan = before_run(V.balance(stored))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in plan
    assert "ReadSchema: struct<from_account:int,to_account:int,amount:bigint>" in plan


def test_time_carrying_balance_is_one_scan_too(stored):
    plan = before_run(V.balance_with_time(stored))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_as_of_reaches_the_files(stored):
    plan = before_run(V.as_of(stored, F.lit(at(10))).select("id"))
    assert "PushedFilters: [IsNotNull(ts), LessThanOrEqual(ts" in plan
    assert "ReadSchema: struct<id:bigint,ts:timestamp>" in plan


def test_late_rule_only_scans_the_input(stored):
    plan = before_run(lateness.accepted(stored, timedelta(seconds=5)))
    assert "BroadcastHashJoin" in plan and "Sort" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_late_rule_without_broadcast(spark, stored, shuffled_joins):
    kept = lateness.accepted(stored, timedelta(seconds=5))
    assert "SortMergeJoin" in before_run(kept)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept.exceptAll(lateness.accepted(stored, timedelta(seconds=5))).count() == 0


def test_keyed_table_aggregates_by_hash_before_the_shuffle(stored):
    plan = before_run(C.latest(stored.withColumn("key", F.col("id") % 500), "key", "arrival"))
    assert "SortAggregate" not in plan and "partial_max_by" in plan


def test_self_join_reads_and_shuffles_ids_only(stored, shuffled_joins):
    plan = before_run(V.outer_join(stored, stored))
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning(id") == 2
    assert plan.count("ReadSchema: struct<id:bigint>") == 2


def test_running_maximum_shuffles_rows_once_and_no_task_takes_all(stored):
    layout = plan_layout(stored, "arrival")
    plan = after_run(lateness.late_split(stored, timedelta(seconds=5), layout))
    over_everything = [line for line in plan.splitlines() if "SinglePartition" in line]
    assert len(over_everything) == 1  # bucket totals, one row per bucket
    assert plan.count("Exchange hashpartitioning(__bucket") == 2
    assert len(layout.splits) >= 31


def test_eager_total_reuses_its_shuffle(stored):
    plan = after_run(C.total_by_tick(C.eager_steps(stored)))
    assert "ReusedExchange" in plan
    assert not re.search(r"Exchange hashpartitioning\(account#\d+, \d+\).*\n.*Project.*tick", plan)


@pytest.mark.parametrize("form", ["balance", "eager", "join", "late", "self"])
def test_no_cross_join_and_no_python_rows(stored, form):
    steps = C.event_time_steps(stored)
    df = {
        "balance": lambda: V.balance(stored),
        "eager": lambda: C.total_changelog(C.eager_steps(stored)),
        "join": lambda: C.join_changelogs(
            C.credits_changelog(steps), C.debits_changelog(steps), "account", "credits", "debits",
            lambda a, b: a - b, "balance", layout=steps.layout,
        ),
        "late": lambda: lateness.late_refinements(stored, 100, timedelta(seconds=5)),
        "self": lambda: C.self_join_changelog(stored),
    }[form]()
    plan = before_run(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in plan


def test_fine_ticks_give_the_same_rows(stored):
    for seconds in (0, 5):
        wait = timedelta(seconds=seconds)
        coarse, fine = (lateness.accepted(stored, wait, fine_ticks=f) for f in (False, True))
        assert coarse.exceptAll(fine).count() == 0 and fine.exceptAll(coarse).count() == 0
        assert coarse.count() > 0
