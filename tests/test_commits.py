"""Updates that become visible at once and only once, with failures injected at every step."""

import shutil
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.operators.ranges import Grid
from millrace.sources import commits
from millrace.streaming import jobs as streams


def seen(spark, table, log):
    rows = commits.read_committed(spark, table, log, "update_id string, v long").collect()
    return sorted(((r.update_id, r.v) for r in rows), key=lambda x: (x[0] or "", x[1]))


def test_entries_are_created_once(spark, tmp_path):
    log = str(tmp_path / "log")
    assert commits.last_version(spark, log) == 0 and commits.committed(spark, log).count() == 0
    assert commits.add_entry(spark, log, 1, "a") and not commits.add_entry(spark, log, 1, "b") and commits.add_entry(spark, log, 2, "c")
    assert sorted(map(tuple, commits.committed(spark, log).collect())) == [(1, "a"), (2, "c")] and commits.last_version(spark, log) == 2
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_failure_changes_nothing(spark, tmp_path, monkeypatch):
    table, log, extra = (str(tmp_path / n) for n in ("t", "log", "extra"))
    rows = lambda *r: spark.createDataFrame(r, "update_id string, v long")
    sums = {extra: lambda added: added.agg(F.sum("v").alias("s"))}
    told = lambda: (seen(spark, table, log), sorted(r.s for r in commits.read_committed(spark, extra, log, "s long").collect()))
    assert commits.apply_updates(rows(("a", 1), ("a", 2), (None, 3)), table, log, parts=sums)
    before = told()
    assert before == ([(None, 3), ("a", 1), ("a", 2)], [6])
    assert not commits.apply_updates(rows(("a", 9), (None, 9)), table, log, parts=sums) and told() == before

    def broken(added):
        raise OSError("lost")

    with pytest.raises(OSError):
        commits.apply_updates(rows(("b", 4)), table, log, parts={extra: broken})
    assert told() == before
    with monkeypatch.context() as m:
        m.setattr(commits, "add_entry", broken_entry)
        with pytest.raises(OSError):
            commits.apply_updates(rows(("b", 4)), table, log, parts=sums)
    assert told() == before
    assert commits.apply_updates(rows(("b", 4), ("a", 7)), table, log, parts=sums)
    assert told()[1] == [4, 6] and ("b", 4) in told()[0] and ("a", 7) not in told()[0]
    assert commits.remove_uncommitted(spark, log, table, extra) == 5 and told()[1] == [4, 6]


def broken_entry(*_):
    raise OSError("lost")


def test_the_second_of_two_writers_looks_again(spark, tmp_path, monkeypatch):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, "update_id string, v long")
    add, turns = commits.add_entry, []

    def late(*args):
        if not turns:
            turns.append(1)
            assert commits.apply_updates(rows(("a", 1), ("b", 2)), table, log)
        return add(*args)

    monkeypatch.setattr(commits, "add_entry", late)
    assert commits.apply_updates(rows(("b", 20), ("c", 30)), table, log)
    assert seen(spark, table, log) == [("a", 1), ("b", 2), ("c", 30)]
    assert commits.remove_uncommitted(spark, log, table) == 0


def test_stream_without_its_checkpoint(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 5)], "update_id string, v long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    for i in range(3):
        if i < 2:
            rows.filter(f"{i} = 0 or v = 2").union(rows.limit(i).withColumn("update_id", F.lit("c"))).write.parquet(str(tmp_path / f"in/{i}"))
        shutil.rmtree(tmp_path / "c", ignore_errors=True)
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        streams.apply_once(source, table, log, str(tmp_path / "c")).awaitTermination()
        got = sorted(r.update_id for r in commits.read_committed(spark, table, log).collect())
        assert got == (["a", "b"] if i == 0 else ["a", "b", "c"])
    assert commits.last_version(spark, log) == 2


def test_ingest_by_update(spark, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "log")
    day = lambda d: datetime(2024, 1, d)
    bounds = spark.range(1).select(F.lit(day(1)).cast("timestamp_ntz").alias("start"), F.lit(day(6)).cast("timestamp_ntz").alias("stop"))
    for i, days in enumerate([(1, 2), (2, 4)] + [()]):
        if days:
            spark.createDataFrame([(f"file{i}", day(d)) for d in days], "update_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        shutil.rmtree(tmp_path / "c", ignore_errors=True)
        source = spark.readStream.schema("update_id string, ts timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        streams.ingest_updates(source, table, log, Grid("day"), bounds, str(tmp_path / "c")).awaitTermination()
    metrics = commits.read_committed(spark, f"{table}-metrics", log).collect()
    assert sorted((r.complete_count, r.expected_count) for r in metrics) == [(2, 5), (3, 5)]
    assert commits.read_committed(spark, table, log).count() == 4


def test_a_batch_that_is_run_again_overwrites_its_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1),)], "ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    bounds = spark.range(1).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("start"), F.lit(datetime(2024, 1, 3)).cast("timestamp_ntz").alias("stop"))
    for _ in range(2):
        shutil.rmtree(tmp_path / "c", ignore_errors=True)
        source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        streams.ingest_with_metrics(source, str(tmp_path / "t"), str(tmp_path / "m"), Grid("day"), bounds, str(tmp_path / "c")).awaitTermination()
    [row] = spark.read.parquet(str(tmp_path / "m")).collect()
    assert (row.batch, row.complete_count, row.expected_count) == (0, 1, 2)
