"""Ranks, runs and windows of groups of any size."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import markers, ranges, runs, scan


def test_ranks_are_row_numbers(spark):
    random.seed(3)
    rows = [(random.choice(["a", "a", "b", None, f"k{i % 50}"]), random.choice([0.5, None, 2.0]), i, [i]) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, p double, i int, extra array<int>").repartition(7)
    window = Window.partitionBy("k", "p").orderBy(F.desc("i"))
    want = {(r.i, r.n) for r in df.withColumn("n", F.row_number().over(window)).collect()}
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            for enabled in ("true", "false"):
                spark.conf.set("spark.sql.adaptive.enabled", enabled)
                out = scan.ranked(df, ["k", "p"], [F.desc("i")], "n")
                assert {(r.i, r.n) for r in out.collect()} == want and out.columns == ["k", "p", "i", "extra", "n"]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert scan.ranked(df.limit(0), ["k"], ["i"]).count() == 0


def test_nan_is_one_group(spark):
    nan = float("nan")
    df = spark.createDataFrame([(x, i) for i, x in enumerate([nan, 1.0, nan, None, -0.0, 0.0, nan, None])], "k double, i int")
    assert {(r.i, r["rank"]) for r in scan.ranked(df, ["k"], ["i"]).collect()} == {(0, 1), (2, 2), (6, 3), (1, 1), (3, 1), (7, 2), (4, 1), (5, 2)}


def test_no_task_reads_a_hot_key(spark):
    """A key with a third of all rows, and one with another third, are dealt evenly, and numbered through."""
    df = spark.range(0, 60_000, 1, 6).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise(F.concat(F.lit("k"), (F.col("id") % 1009).cast("string"))).alias("k"), F.xxhash64("id").alias("at"), "id")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in scan.placed(df, ["k"], ["at"]).groupBy(F.spark_partition_id()).count().collect()]
        out = scan.ranked(df, ["k"], ["at"]).persist()
        totals = {r.k: (r.rows, r.distinct, r.most) for r in out.groupBy("k").agg(F.count("*").alias("rows"), F.count_distinct("rank").alias("distinct"), F.max("rank").alias("most")).collect()}
        hot = [r.at for r in out.filter("k = 'hot'").orderBy("rank").select("at").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 24 and max(sizes) < 2.5 * sorted(sizes)[12]
    assert totals["hot"] == totals["warm"] == (20_000, 20_000, 20_000) and all(len(set(x)) == 1 for x in totals.values())
    assert hot == sorted(hot)


def test_trailing_failures_against_plain_python(spark):
    random.seed(4)
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(i, random.choice(["hot", "hot", "b", None]), random.choice(["FAILED", "FAILED", "DONE"]), t(random.randint(0, 400) + random.random())) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id int, run string, status string, ts timestamp_ntz")
    second = lambda x: int((x - t(0)).total_seconds())
    failed = [r for r in rows if r[2] == "FAILED"]
    for width in (7, 60):
        want = {r[0]: sum(x[1] == r[1] and 0 <= second(r[3]) - second(x[3]) <= width for x in failed) for r in failed}
        assert {r.event_id: r.failures for r in runs.trailing_failures(df, seconds=width).collect()} == want
    first = {k: min(x[3] for x in failed if x[1] == k) for k in ("hot", "b", None)}
    got = runs.disable_rule(df, seconds=7, retry_count=9, hard_timeout=300).collect()
    assert {r.event_id: r.since_first for r in got} == {r[0]: int((r[3] - first[r[1]]).total_seconds()) for r in failed}


def test_trailing_failures_sort_few_rows(spark):
    """What the window sorts is bounded by its seconds, not by a key's failures."""
    df = spark.range(30_000).select(F.col("id").alias("event_id"), F.concat(F.lit("hot"), F.substring(F.col("id").cast("string"), 99, 1)).alias("run"), F.lit("FAILED").alias("status"), F.timestamp_seconds((F.col("id") % 7200).cast("long")).alias("ts"))
    out = runs.trailing_failures(df, seconds=59)
    assert out.count() == 30_000 and out.agg(F.max("failures")).first()[0] == 60 * 5
    assert "hashpartitioning(__key" in out._jdf.queryExecution().executedPlan().toString()


def test_islands_of_a_key_in_many_partitions(spark):
    days = [date(2000, 1, 1) + timedelta(days=i) for i in range(4000) if i % 97]
    df = spark.createDataFrame([("hot", d) for d in days] + [("b", days[0])], "k string, day date")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = [(r.first, r.n) for r in ranges.islands(df, "k").filter("k = 'hot'").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 42 and Counter(n for _, n in got)[96] == 41 and sum(n for _, n in got) == len(days)


def test_history_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(F.concat(F.lit("t"), F.substring(F.col("id").cast("string"), 99, 1)).alias("target"), F.col("id").alias("at"), F.col("id").cast("string").alias("u"))
    out = markers.trim_history(df, "target", "at", "u", 3)
    assert sorted(r.at for r in out.collect()) == [997, 998, 999]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.rindex("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")
