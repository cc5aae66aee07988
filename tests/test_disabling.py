"""Disabling as a stream: what the batch tells of the same events, over restarts and out of order."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import runs
from millrace.operators.disabling import Rule
from millrace.plans.queries import events
from millrace.streaming import disabling

DAY = 86400


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, disabling.STORE)
    yield
    spark.conf.set(name, before)


def test_stream_agrees_with_the_batch_over_restarts(spark, sf, store, tmp_path):
    rule = Rule(10 * DAY, 2, 20 * DAY, 5 * DAY)
    rows = events(spark, sf).filter("run % 5 = 0").select("run", "event_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    every = sorted(map(tuple, rows.collect()), key=lambda r: r[3])
    now = every[-1][3] + timedelta(days=2)
    # Three restarts, each with a third of the events in no order, which overlap with the next ones by a day.
    order = sorted(every, key=lambda r: r[3] + timedelta(hours=24 * (r[1] * 7919 % 10) / 10))
    cuts = [order[: len(order) // 3], order[len(order) // 3 : 2 * len(order) // 3], order[2 * len(order) // 3 :]]
    cuts.append([(-1, -1, "PENDING", now + timedelta(days=3))])  # the clock goes on
    for i, part in enumerate(cuts):
        spark.createDataFrame(part, rows.schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        out = disabling.disable_changes(source, rule, late="3 days").writeStream.option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True)
        out.start().awaitTermination()
    got = sorted((r.run, r.ts, r.change) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = runs.disable_changes(rows, seconds=rule.seconds, retry_count=2, hard_timeout=rule.hard_timeout, persist=rule.persist, now=now)
    want = sorted((r.run, r.ts, r.change) for r in batch.collect())
    assert got == want and {c for *_, c in want} == {"ENABLED", "DISABLED"}
    by_time = batch.filter("event_id IS NULL").count()
    assert 0 < by_time < len(want)


def test_time_alone_enables_until_now(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([("a", 1, "FAILED", t(1)), ("b", 2, "FAILED", t(1)), ("b", 3, "DONE", t(2)), (None, 4, "FAILED", t(3))], "run string, event_id long, status string, ts timestamp_ntz")
    told = lambda now: sorted(((r.run, r.event_id, r.ts.day, r.change) for r in runs.disable_changes(rows, retry_count=1, persist=5 * DAY, now=now).collect()), key=repr)
    fixed = [("a", 1, 1, "DISABLED"), ("b", 2, 1, "DISABLED"), ("b", 3, 2, "ENABLED"), (None, 4, 3, "DISABLED")]
    assert told(None) == told(t(5)) == sorted(fixed, key=repr)
    assert told(t(6)) == sorted([*fixed, ("a", None, 6, "ENABLED")], key=repr)
    assert told(t(1)) == sorted(fixed[:2], key=repr)
    assert runs.disable_changes(rows.limit(0), now=t(1)).count() == 0
