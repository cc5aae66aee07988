"""Range completeness: expected points, missing ones, backfill choice, metrics, lookback and runs."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import ranked

#: How far back a range looks from now by default, in points of its grid.
BACK = {"day": 100, "hour": 2400, "minute": 1440, "month": 13}
TASK_LIMIT = 50


@dataclass(frozen=True)
class Grid:
    """A grid of points: day, hour, month, or every ``every`` minutes (a divisor of 60)."""

    unit: str
    every: int = 1

    def __post_init__(self):
        if self.unit not in BACK:
            raise ValueError(f"no grid of {self.unit}s")
        if self.unit == "minute" and not (1 <= self.every <= 59 and 60 % self.every == 0):
            raise ValueError("minutes must divide 60")

    @property
    def step(self) -> str:
        return f"INTERVAL {self.every} {self.unit.upper()}"

    def floor(self, ts: Column) -> Column:
        base = F.date_trunc("hour" if self.unit == "minute" else self.unit, ts).cast("timestamp_ntz")
        if self.unit != "minute":
            return base
        return F.timestamp_add("MINUTE", (F.minute(ts) - F.minute(ts) % self.every).cast("int"), base)

    def ceil(self, ts: Column) -> Column:
        low = self.floor(ts)
        return F.when(low == ts.cast("timestamp_ntz"), low).otherwise(low + F.expr(self.step))


def bounds(start: datetime | None, stop: datetime | None, now: datetime, back: timedelta, forward: timedelta = timedelta(0), reverse: bool = False) -> tuple[datetime, datetime] | None:
    """The part of [start, stop) that is looked at around ``now``; None if empty.

    Errors: neither bound given; no start unless in reverse; start after stop.
    """
    if start is None and stop is None:
        raise ValueError("a range needs a start or a stop")
    if start is None and not reverse:
        raise ValueError("a range without a start runs in reverse only")
    if start is not None and stop is not None and start > stop:
        raise ValueError("the start is after the stop")
    low = max(start, now - back) if start is not None else now - back
    high = min(stop, now + forward) if stop is not None else now + forward
    return (low, high) if low <= high else None


def window_bounds(df: DataFrame, now: Column, back: str, forward: str) -> DataFrame:
    """``bounds`` for many datasets at once: columns start and stop (null: open) to low, high and empty."""
    low = F.greatest(F.col("start"), now - F.expr(back))
    high = F.least(F.col("stop"), now + F.expr(forward))
    return df.withColumn("low", low).withColumn("high", high).withColumn("empty", low > high)


def expected(df: DataFrame, grid: Grid, start: str = "start", stop: str = "stop") -> DataFrame:
    """One row per grid point ts with start <= ts < stop, for each row of ``df``; other columns are kept."""
    a, b = grid.ceil(F.col(start)), F.col(stop).cast("timestamp_ntz")
    if grid.unit == "month":
        b = grid.floor(b)
    points = F.when(a < b, F.sequence(a, b, F.expr(grid.step)))
    return df.withColumn("ts", F.explode(points)).filter(F.col("ts") < b)


def expected_between(spark: SparkSession, grid: Grid, start: datetime, stop: datetime) -> DataFrame:
    one = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("start"), F.lit(stop).cast("timestamp_ntz").alias("stop"))
    return expected(one, grid).select("ts")


def missing(expected_: DataFrame, present: DataFrame, *on: str) -> DataFrame:
    """Expected points that aren't present."""
    return expected_.join(present.select(*on), list(on), "left_anti")


def complete(requested: DataFrame, present: DataFrame, *on: str) -> DataFrame:
    """Of the requested keys, those present."""
    return requested.join(present.select(*on), list(on), "left_semi")


def complete_outputs(requested: DataFrame, listed: DataFrame, key: str, output: str) -> DataFrame:
    """Per key whether all its requested outputs are listed."""
    found = listed.select(key, output).distinct().withColumn("__here", F.lit(True))
    return requested.join(found, [key, output], "left").groupBy(key).agg(F.bool_and(F.coalesce("__here", F.lit(False))).alias("complete"))


def wrapper_complete(groups: DataFrame, members: DataFrame, key: str, done: str, wrapper: bool = True) -> DataFrame:
    """Per group whether all members are done; a group without members counts as done for a wrapper only."""
    all_done = members.groupBy(key).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("complete"))
    return groups.select(key).distinct().join(all_done, key, "left").withColumn("complete", F.coalesce("complete", F.lit(wrapper)))


def choose_backfill(missing_: DataFrame, limit: int = TASK_LIMIT, reverse: bool = False) -> DataFrame:
    """The first ``limit`` missing points, or in reverse the last ones, newest first."""
    return missing_.orderBy(F.desc("ts") if reverse else F.asc("ts")).limit(limit)


def range_metrics(expected_: DataFrame, present: DataFrame, *by: str) -> DataFrame:
    """delay (expected points from the first missing one on), complete_count, complete_fraction, expected_count and label.

    The label is the first and last expected point. One row, or one for each value of ``by``.
    """
    here = present.select(*by, "ts").distinct().withColumn("__here", F.lit(1))
    marked = expected_.select(*by, "ts").join(here, [*by, "ts"], "left")
    first = marked.groupBy(*by).agg(F.min(F.when(F.col("__here").isNull(), F.col("ts"))).alias("first_missing"))
    joined = marked.join(first, list(by)) if by else marked.join(F.broadcast(first))  # one row
    minute = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    label = F.concat(F.lit("["), minute(F.min("ts")), F.lit(", "), minute(F.max("ts")), F.lit("]"))
    counted = joined.groupBy(*by).agg(F.count_if(F.col("ts") >= F.col("first_missing")).alias("delay"), F.count("__here").alias("complete_count"), F.count(F.lit(1)).alias("expected_count"), label.alias("label"))
    fraction = F.when(F.col("expected_count") == 0, 1.0).otherwise(F.col("complete_count") / F.col("expected_count")).alias("complete_fraction")
    return counted.select(*by, "delay", "complete_count", fraction, "expected_count", "label")


def widened(low: Column, high: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """The range that metrics are taken over: the window and the asked range together."""
    return F.least(low, start), F.greatest(high, stop)


def external_readiness(requests: DataFrame, files: DataFrame, tables: DataFrame, partitions: DataFrame) -> DataFrame:
    """Requests (kind, target) with ``ready``: whether the external dataset is there.

    Kinds: path (a file, or a folder that holds one), flag (a folder with a _SUCCESS file), table, and partition. The
    listing ``files`` has path; ``tables`` and ``partitions`` have target. Another kind is never ready.
    """
    steps = F.split("path", "/")
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("target"))
    flags = files.filter(F.col("path").endswith("/_SUCCESS")).select(F.regexp_replace("path", "/_SUCCESS$", "").alias("target"))
    kinds = {"path": above, "flag": flags, "table": tables.select("target"), "partition": partitions.select("target")}
    there = None
    for kind, found in kinds.items():
        one = found.distinct().select(F.lit(kind).alias("kind"), F.col("target").alias("__t"), F.lit(True).alias("__there"))
        there = one if there is None else there.unionByName(one)
    asked = requests.withColumn("__t", F.regexp_replace("target", "/$", ""))
    return asked.join(there, ["kind", "__t"], "left").withColumn("ready", F.coalesce("__there", F.lit(False))).drop("__t", "__there")


def _asof(requests: DataFrame, present: DataFrame, key: str, days: int, offset: int) -> DataFrame:
    """For each request of (key, day) the newest present day from day - offset - days + 1 to day - offset.

    A range join with an equality: days fall into buckets as long as the lookback, and a present day serves its own
    bucket and the next, which is where any request that can see it lies.
    """
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    asked = requests.select(key, "day").distinct().withColumn("__b", bucket(F.date_sub("day", offset)))
    there = present.select(F.col(key), F.col("day").alias("__p")).distinct().withColumn("__b", F.explode(F.array(bucket(F.col("__p")), bucket(F.col("__p")) + 1)))
    near = (F.col("__p") <= F.date_sub("day", offset)) & (F.col("__p") > F.date_sub("day", offset + days))
    found = asked.join(there, [key, "__b"]).filter(near).groupBy(key, "day").agg(F.max("__p").alias("found_day"))
    return requests.select(key, "day").distinct().join(found, [key, "day"], "left")


def latest_snapshot(requests: DataFrame, present: DataFrame, key: str, lookback: int = 14) -> DataFrame:
    """The newest complete day in (day - lookback, day]; if none, the oldest candidate, which isn't complete yet."""
    found = _asof(requests, present, key, lookback, 0)
    return found.select(key, "day", F.coalesce("found_day", F.date_sub("day", lookback - 1)).alias("snapshot"), F.col("found_day").isNotNull().alias("found"))


def previous_complete(requests: DataFrame, present: DataFrame, key: str, max_steps: int = 10) -> DataFrame:
    """The newest complete day among the ``max_steps`` days before each day; null if none."""
    return _asof(requests, present, key, max_steps, 1).withColumnRenamed("found_day", "previous")


def previous_period(df: DataFrame, unit: str, *columns: str) -> DataFrame:
    """The one date column moved back by a period; an error for none or several."""
    if len(columns) != 1:
        raise ValueError("exactly one date column is needed")
    return df.withColumn(columns[0], F.col(columns[0]) - F.expr(f"INTERVAL 1 {unit}"))


def islands(df: DataFrame, key: str, day: str = "day", least: int = 3) -> DataFrame:
    """Unbroken runs of days per key: first, last, n and a label, "first...last" for more than ``least`` days.

    A day less its number among its key's days is the same all along a run.
    """
    numbered = ranked(df.select(key, day).distinct(), [key], [day], "__place")
    runs = numbered.withColumn("__run", F.date_sub(F.col(day), F.col("__place").cast("int"))).groupBy(key, "__run")
    out = runs.agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("n")).drop("__run")
    several = F.concat(F.col("first").cast("string"), F.lit("..."), F.col("last").cast("string"))
    listed = F.array_join(F.transform(F.sequence("first", "last"), lambda d: d.cast("string")), ",")
    return out.withColumn("label", F.when(F.col("n") > least, several).otherwise(listed))


def partition_key(columns: list[str]) -> Column:
    """k=v/... with the columns sorted by name."""
    return F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in sorted(columns)))


def partitions_present(requested: DataFrame, existing: DataFrame | None, columns: list[str], missing_table: str = "absent") -> DataFrame:
    """Requested partitions with key and present, whatever the order of the columns on either side.

    Without a table (``existing`` is None) no partition is there, or with ``missing_table="error"`` that is an error.
    """
    asked = requested.withColumn("key", partition_key(columns))
    if existing is None:
        if missing_table == "error":
            raise LookupError("the table of the partitions isn't there")
        return asked.withColumn("present", F.lit(False))
    there = existing.select(partition_key(columns).alias("key")).distinct().withColumn("__here", F.lit(True))
    return asked.join(there, "key", "left").withColumn("present", F.coalesce("__here", F.lit(False))).drop("__here")


def table_partitions(spark: SparkSession, table: str) -> DataFrame | None:
    """The partitions of a catalog's table, a text column for each partition column; None if there is no such table.

    They come from the catalog alone: no file is listed or read.
    """
    if not spark.catalog.tableExists(table):
        return None
    columns = [c.name for c in spark.catalog.listColumns(table) if c.isPartition]
    shown = spark.sql(f"SHOW PARTITIONS {table}")
    value = lambda i: F.try_element_at(F.split(F.get(F.split("partition", "/"), i), "=", 2), F.lit(2))
    return shown.select(*(F.url_decode(value(i)).alias(c) for i, c in enumerate(columns)))


def partition_rows(requested: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """Rows of each requested partition and whether there are any."""
    counts = table.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))
    return requested.join(counts, list(columns), "left").withColumn("rows", F.coalesce("rows", F.lit(0))).withColumn("present", F.col("rows") > 0)
