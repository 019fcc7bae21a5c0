from datetime import timedelta

import pytest
from conftest import rows, tick
from pyspark.sql import functions as F

from tickledger import workspace
from tickledger.functions import render
from tickledger.operators import lateness
from tickledger.sinks import publish
from tickledger.sources import generate, kafka
from tickledger.sources import transactions as S

GOOD = '{"id": 17, "from_account": 3, "to_account": 8, "amount": 1, "ts": "2021-01-01 00:00:05.000"}'
BAD = {
    "broken JSON": "{bad",
    "impossible minute": GOOD.replace("00:00:05", "00:60:00"),
    "text amount": GOOD.replace('"amount": 1', '"amount": "x"'),
    "fractional amount": GOOD.replace('"amount": 1', '"amount": 1.5'),
    "missing field": '{"id": 1}',
    "null field": GOOD.replace('"amount": 1', '"amount": null'),
}


def lines_file(tmp_path, *lines):
    (tmp_path / "in.json").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_json_lines(spark, tmp_path):
    got = S.read_json_lines(spark, lines_file(tmp_path, GOOD, GOOD.replace("17", "18")))
    assert rows(got.select("id", "from_account", "to_account", "amount", F.unix_micros("ts"))) == [
        (17, 3, 8, 1, tick(5)),
        (18, 3, 8, 1, tick(5)),
    ]


@pytest.mark.parametrize("bad", BAD.values(), ids=BAD.keys())
def test_strict_reader_fails(spark, tmp_path, bad):
    df = S.read_json_lines(spark, lines_file(tmp_path, GOOD, bad))
    with pytest.raises(Exception, match="(?i)malformed|missing field"):
        df.collect()
    with pytest.raises(Exception, match="(?i)malformed|missing field"):
        S.read_json_lines(spark, str(tmp_path)).select("id").collect()


@pytest.mark.parametrize("bad", BAD.values(), ids=BAD.keys())
def test_strict_decoder_fails(spark, bad):
    messages = spark.createDataFrame([(bytearray(bad, "utf-8"),)], "value binary")
    with pytest.raises(Exception, match="(?i)malformed|missing field"):
        S.decode_json(messages).collect()


def test_keyed_lines_split_at_the_first_bar_only(spark):
    lines = spark.createDataFrame([('5|{"note": "a|b"}',)], "line string")
    assert rows(S.split_keyed_lines(lines)) == [("5", '{"note": "a|b"}')]


def test_keyed_round_trip(spark, six):
    back = S.decode_json(S.split_keyed_lines(S.keyed_lines(six)))
    assert rows(back.drop("key")) == rows(six.drop("arrival"))
    assert S.keyed_lines(six).first().line == (
        '0|{"id":0,"from_account":0,"to_account":1,"amount":10,"ts":"2021-01-01 00:00:00.000"}'
    )


def test_simplified_data_goes_round_a_ring(spark):
    n = 600
    got = generate.simplified(spark.range(n), F.lit(n))
    assert got.select("ts").distinct().count() == 60
    assert got.where("to_account <> (from_account + 1) % 10 or amount <> 1").count() == 0
    assert lateness.accepted(got, timedelta(seconds=5)).count() == n


def test_original_data_is_disordered_as_described(spark):
    n = 60_000
    got = generate.original(spark.range(n), F.lit(n)).cache()
    stats = got.agg(
        F.count_distinct("arrival"), F.min("arrival"), F.max("arrival"), F.count_distinct("ts"), F.min("from_account"),
        F.max("from_account"), F.min("to_account"), F.max("to_account"), F.min("amount"), F.max("amount"),
    ).first()
    assert tuple(stats) == (n, 0, n - 1, 60, 0, 9, 0, 9, 1, 1)
    share = lateness.accepted(got, timedelta(seconds=5)).count() / n
    assert 0.62 < share < 0.66
    again = generate.original(spark.range(n).repartition(9), F.lit(n))
    assert got.exceptAll(again).count() == 0


def test_kafka_options():
    options = kafka.read_options("host:9092", "transactions", offsets_per_batch=1000)
    assert options["startingOffsets"] == "earliest" and options["subscribe"] == "transactions"
    assert options["maxOffsetsPerTrigger"] == "1000" and options["failOnDataLoss"] == "true"
    assert kafka.write_options("host:9092", "total", "/c") == {
        "kafka.bootstrap.servers": "host:9092",
        "topic": "total",
        "checkpointLocation": "/c",
    }


def test_rendering(spark):
    log = spark.createDataFrame([(1, 3, 17, 1), (2, 3, 17, -2), (2, 4, None, 1)], "tick bigint, a int, b int, diff int")
    assert [r.line for r in render.retract_lines(log, ["a", "b"]).collect()] == ["insert 3,17", "delete 3,17", "insert 4,null"]
    assert [r.line for r in render.multiset_lines(log, ["a", "b"]).collect()] == [
        "insert 1x (3, 17) at 1",
        "delete 2x (3, 17) at 2",
        "insert 1x (4, null) at 2",
    ]
    messages = render.json_messages(log.select("a", "b"), "a")
    assert rows(messages)[2] == ("4", '{"a":4,"b":null}')


def test_totals_are_parsed_back(spark):
    lines = spark.createDataFrame([("insert 5",), ("delete 5",), ("insert -12",), ("insert null",)], "line string")
    assert [r.total for r in render.parse_totals(lines).collect()] == [5, -12, None]
    messages = spark.createDataFrame([('{"foo":"foo","total":-3}',)], "value string")
    assert rows(render.parse_json_totals(messages, "total")) == [(-3,)]


def test_text_files_read_back_in_tick_order(spark, tmp_path):
    log = spark.range(1000, numPartitions=4).select(
        (F.lit(1000) - F.col("id")).alias("tick"), F.lit(1).alias("diff"), F.lpad(F.col("id").cast("string"), 4, "0").alias("line")
    )
    path = str(tmp_path / "lines")
    publish.write_lines(log, path)
    parts = sorted(p for p in (tmp_path / "lines").iterdir() if p.suffix == ".txt")
    text = [line for p in parts for line in p.read_text().split()]
    assert text == [f"{i:04d}" for i in reversed(range(1000))]
    assert publish.read_lines(spark, path).count() == 1000


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    for name, ids in (("b", range(500, 1200)), ("a", range(500)), ("c", range(1200, 1203))):
        lines = [f'{{"id":{i},"from_account":0,"to_account":1,"amount":1,"ts":"2021-01-01 00:00:00.000"}}' for i in ids]
        (tmp_path / f"{name}.json").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # files are read in several blocks, out of order
    try:
        got = S.read_numbered_json_lines(spark, str(tmp_path))
        assert got.where("id <> arrival").count() == 0 and got.count() == 1203
        assert got.rdd.getNumPartitions() > 3 and got.select("file").distinct().count() == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_no_temporary_folder_on_a_cluster():
    class Remote:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_folder(Remote)
