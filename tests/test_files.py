"""Sources, sinks and streams on small files."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import ranges
from millrace.sources import readers, sinks
from millrace.streaming import jobs


def test_delimited_and_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text('1||x y\n2||"q\n')
    got = readers.read_delimited(spark, str(tmp_path / "a.txt"), "n int, s string", "||").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, "x y"), (2, '"q')]
    files = readers.list_files(spark, str(tmp_path))
    assert files.count() == 1
    assert readers.dataset_usage(files, F.lit("d")).first()["bytes"] == (tmp_path / "a.txt").stat().st_size


def test_reject_limit(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"n": 1}\n{bad\n')
    with pytest.raises(ValueError):
        readers.load_files(spark, str(tmp_path / "a.json"), "json", "n int")
    assert readers.load_files(spark, str(tmp_path / "a.json"), "json", "n int", max_bad=1).collect()[0]["n"] == 1


def test_publish_and_validate(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(ValueError):
        sinks.validate_and_publish(spark.range(5), path, {"small": F.col("id") < 3})
    assert not (tmp_path / "out").exists()
    sinks.validate_and_publish(spark.range(5), path, {"small": F.col("id") < 5})
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(1), path)


def test_idempotent_load(spark, tmp_path):
    table, marks = str(tmp_path / "t"), str(tmp_path / "m")
    assert sinks.idempotent_load(spark.range(3), table, marks, "u1")
    assert not sinks.idempotent_load(spark.range(3), table, marks, "u1")
    assert sinks.read_marked(spark, table, marks).count() == 3


def test_dispositions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.write_disposed(spark.range(1), path, create="CREATE_NEVER")
    sinks.write_disposed(spark.range(0), path)
    sinks.write_disposed(spark.range(2), path)
    with pytest.raises(FileExistsError):
        sinks.write_disposed(spark.range(2), path)
    sinks.write_disposed(spark.range(2), path, "APPEND")
    assert spark.read.parquet(path).count() == 4


def test_manifest_and_flag(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello\n")
    readers.write_manifest(spark, readers.list_files(spark, str(tmp_path)), str(tmp_path / "m.json"))
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).count() == 1
    assert not readers.flagged(spark, f"{tmp_path}/")
    with pytest.raises(ValueError):
        readers.flagged(spark, str(tmp_path))


def test_jdbc(spark):
    url, driver = "jdbc:derby:memory:t;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    sinks.jdbc_load(spark.range(5).withColumnRenamed("id", "N"), url, "T1", driver)
    assert spark.read.format("jdbc").option("url", url).option("dbtable", "T1").option("driver", driver).load().count() == 5


def test_paths_and_bounds():
    assert readers.interval_paths("/d/%Y/%m-%d", date(2020, 2, 28), date(2020, 3, 1)) == ["/d/2020/02-28", "/d/2020/02-29"]
    now = datetime(2017, 10, 22, 12, 4, 29)
    got = ranges.bounds(datetime(2011, 3, 20), datetime(2025, 1, 29), now, timedelta(1095), timedelta(1095))
    assert got == (now - timedelta(1095), now + timedelta(1095))
    for bad in ((None, None), (None, now), (now, now - timedelta(1))):
        with pytest.raises(ValueError):
            ranges.bounds(*bad, now, timedelta(1))
    with pytest.raises(ValueError):
        ranges.Grid("minute", 7)


def test_daily_range(spark):
    """The surveyed case: 7 first points missing, four chosen, delay 3750."""
    start, stop = datetime(2014, 10, 24), datetime(2020, 10, 22)
    points = ranges.expected_between(spark, ranges.Grid("day"), start, stop)
    present = points.filter(F.col("ts") >= F.lit(datetime(2014, 10, 31)).cast("timestamp_ntz"))
    chosen = [r["ts"] for r in ranges.choose_backfill(ranges.missing(points, present, "ts"), 4).collect()]
    assert chosen == [start + timedelta(i) for i in range(4)]


def test_stream_applies_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "update_id string, v double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in/1"))
    rows.write.parquet(str(tmp_path / "in/2"))
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.apply_once(source, str(tmp_path / "t"), str(tmp_path / "m"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_stream_failure_rate(spark, tmp_path):
    rows = spark.createDataFrame([(1, "FAILED", "2024-01-01 00:30:00"), (1, "FAILED", "2024-01-01 00:40:00"), (1, "DONE", "2024-01-01 00:41:00")], "run int, status string, t string")
    rows = rows.withColumn("ts", F.col("t").cast("timestamp")).drop("t")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = jobs.failure_rate(source, "run", "1 hour", "1 hour").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["failures"] for r in spark.sql("select failures from rates").collect()] == [2]
