"""Running values against a plain loop, with splitting forced and one key holding most rows."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tickledger.operators import scan
from tickledger.operators.scan import Fold, plan_layout, prefix_scan

FOLDS = {
    "s": Fold("sum", "v"),
    "s_before": Fold("sum", "v", exclusive=True),
    "hi": Fold("max", "v"),
    "lo_before": Fold("min", "v", exclusive=True),
    "seen": Fold("last", "w"),
    "seen_before": Fold("last", "w", exclusive=True),
}


def expected(data, keyed, descending):
    out, groups = [], {}
    for k, t, v, w in sorted(data, key=lambda r: r[1], reverse=descending):
        g = groups.setdefault(k if keyed else 0, {"s": 0, "hi": None, "lo": None, "w": None})
        before = dict(g)
        g["s"] += v
        g["hi"] = v if g["hi"] is None else max(g["hi"], v)
        g["lo"] = v if g["lo"] is None else min(g["lo"], v)
        g["w"] = g["w"] if w is None else w
        out.append((k, t, v, w, g["s"], before["s"], g["hi"], before["lo"], g["w"], before["w"]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    ticks = rng.sample(range(100_000), 3000)
    # Key 0 holds two thirds of the rows, crowded into a narrow stretch of time.
    return [
        (0 if rng.random() < 0.66 else rng.randrange(1, 200), t, rng.randrange(-9, 9), rng.choice([None, t]))
        for t in ticks
    ]


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("descending", [True, False])
def test_matches_a_loop(spark, data, keyed, descending):
    df = spark.createDataFrame(data, "k int, t bigint, v bigint, w bigint").repartition(5)
    keys = ["k"] if keyed else []
    layout = plan_layout(df, "t", keys, buckets=7)
    assert len(layout.splits) == 6
    got = prefix_scan(df, FOLDS, order=["t"], keys=keys, layout=layout, descending=descending)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(data, keyed, descending)


@pytest.mark.parametrize("descending", [True, False])
def test_bucket_totals_fold_in_levels(spark, data, monkeypatch, descending):
    monkeypatch.setattr(scan, "FOLD_WIDTH", 3)
    df = spark.createDataFrame(data, "k int, t bigint, v bigint, w bigint").repartition(5)
    for keys in (["k"], []):
        layout = plan_layout(df, "t", keys, rows_per_bucket=70)
        assert len(layout.splits) + 1 > 3 * 3 * 3
        got = prefix_scan(df, FOLDS, order=["t"], keys=keys, layout=layout, descending=descending)
        assert sorted((tuple(r) for r in got.collect()), key=str) == expected(data, bool(keys), descending)


def test_buckets_follow_the_rows(spark):
    df = spark.range(1000).withColumnRenamed("id", "t")
    assert plan_layout(df, "t").splits == () and plan_layout(df.limit(0), "t").splits == ()
    assert len(plan_layout(df, "t", rows_per_bucket=10).splits) == 99


def test_small_tables_are_split_among_cores_too(spark):
    df = spark.range(20_000).select(F.col("id").alias("t"), (F.col("id") % 50 * (F.col("id") % 2)).alias("k"))
    cores = spark.sparkContext.defaultParallelism
    assert len(plan_layout(df, "t").splits) + 1 == min(2 * cores, 20_000 // scan.LEAST_ROWS_PER_BUCKET)
    keyed = plan_layout(df, "t", ["k"])
    assert spark.range(1).select(F.xxhash64(F.lit(0).cast("long"))).first()[0] in keyed.hot and keyed.splits
    assert scan._bucket_count(10**9, None, cores) == 4000 and scan._bucket_count(10**9, None, 10**4) == 20_000


def test_hot_key_is_spread_and_cold_keys_stay_whole(spark, data):
    df = spark.createDataFrame(data, "k int, t bigint, v bigint, w bigint")
    layout = plan_layout(df, "t", ["k"], buckets=8)
    assert layout.hot == (spark.range(1).select(F.xxhash64(F.lit(0))).first()[0],)
    got = prefix_scan(df, {"s": Fold("sum", "v")}, order=["t"], keys=["k"], layout=layout)
    text = got._jdf.queryExecution().toString()
    assert "windowspecdefinition(k#" in text and "__bucket#" in text


def test_without_hot_keys_there_is_one_window(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.col("id").alias("t"), F.lit(1).alias("v"))
    layout = plan_layout(df, "t", ["k"], buckets=8)
    assert layout.hot == () and layout.splits == ()
    got = prefix_scan(df, {"s": Fold("sum", "v")}, order=["t"], keys=["k"], layout=layout)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.agg(F.sum("s")).first()[0] == 5000


def test_rows_equal_in_order_are_combined_first(spark):
    raw = [(1, t // 3, 1) for t in range(300)] + [(2, t, 5) for t in range(50)]
    df = spark.createDataFrame(raw, "k int, t bigint, v bigint")
    layout = plan_layout(df, "t", ["k"], buckets=4)
    got = prefix_scan(
        df, {"s": Fold("sum", "n")}, order=["t"], keys=["k"], layout=layout, combine={"n": F.sum("v")}
    )
    assert rows(got) == sorted([(1, t, 3, 3 * (t + 1)) for t in range(100)] + [(2, t, 5, 5 * (t + 1)) for t in range(50)])


def test_unkeyed_layout_comes_from_the_same_sample(spark, data):
    df = spark.createDataFrame(data, "k int, t bigint, v bigint, w bigint")
    layout = plan_layout(df, "t", ["k"], buckets=8).unkeyed()
    assert layout.keys == () and layout.splits
    got = prefix_scan(df, {"s": Fold("sum", "v")}, order=["t"], layout=layout)
    assert rows(got.select("t", "s")) == sorted((r[1], r[4]) for r in expected(data, False, False))


def test_many_hot_keys_of_two_columns(spark):
    raw = [(k % 10, k // 10, t * 100 + k, 1) for k in range(100) for t in range(60)]
    df = spark.createDataFrame(raw, "a int, b int, t bigint, v bigint").repartition(4)
    layout = plan_layout(df, "t", ["a", "b"], buckets=200)
    assert len(layout.hot) == 100 and layout.keys == ("a", "b")
    got = prefix_scan(df, {"s": Fold("sum", "v")}, order=["t"], keys=["a", "b"], layout=layout)
    assert rows(got.select("t", "s")) == sorted((t * 100 + k, t + 1) for k in range(100) for t in range(60))
