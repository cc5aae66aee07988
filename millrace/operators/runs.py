"""Run-history queries over events (run, status, ts, ...), parameters and tasks.

Statuses: PENDING, RUNNING, DONE, FAILED, DISABLED, UNKNOWN.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from datetime import UTC, datetime, timedelta
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .disabling import Rule, changes
from .scan import ranked


def with_parameters(tasks: DataFrame, params: DataFrame, wanted: Mapping[str, str | Column], key: str = "task_id") -> DataFrame:
    """Tasks that have every wanted (name, value) in the parameter table; a value may be a scalar subquery."""
    if not wanted:
        return tasks
    pairs = F.array(*(F.concat(F.lit(f"{k}\0"), F.lit(v)) for k, v in wanted.items()))
    hit = params.filter(F.array_contains(pairs, F.concat(F.col("name"), F.lit("\0"), F.col("value"))))
    full = hit.groupBy(key).agg(F.count_distinct("name").alias("__n")).filter(F.col("__n") == len(wanted))
    return tasks.join(full, key, "left_semi")


def find_runs(tasks: DataFrame, params: DataFrame, events: DataFrame, name: str, wanted: Mapping[str, str | Column], key: str = "task_id") -> DataFrame:
    """Tasks of a name with every wanted parameter, and ``last_ts``, by the time of their last event; without one last."""
    last = events.groupBy(key).agg(F.max("ts").alias("last_ts"))
    return with_parameters(tasks.filter(F.col("name") == name), params, wanted, key).join(last, key, "left").orderBy(F.asc_nulls_last("last_ts"), key)


def events_of(events: DataFrame, ids: DataFrame | None = None, key: str = "run") -> DataFrame:
    """All events, or those of the runs that ``ids`` lists, newest first."""
    found = events if ids is None else events.join(ids.select(key), key, "left_semi")
    return found.orderBy(F.desc("ts"), F.desc("event_id"))


def by_id(tasks: DataFrame, wanted, key: str = "task_id") -> DataFrame:
    return tasks.filter(F.col(key) == wanted)


def latest_by_stable_id(tasks: DataFrame, stable: str, key: str = "task_id") -> DataFrame:
    """The row with the greatest id of each stable id."""
    rest = [c for c in tasks.columns if c not in (stable, key)]
    best = tasks.groupBy(stable).agg(F.max_by(F.struct(key, *rest), key).alias("b"))
    return best.select(stable, *(F.col(f"b.{c}").alias(c) for c in (key, *rest)))


def recent(events: DataFrame, now: Column, hours: int = 24, key: str = "run") -> DataFrame:
    """Runs with an event in the last hours, each once with its newest, newest first."""
    seen = events.filter(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours))).groupBy(key).agg(F.max("ts").alias("last_ts"))
    return seen.orderBy(F.desc("last_ts"), key)


def current_status(events: DataFrame, key: str = "run", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest event of each run by ts and event_id."""
    return events.groupBy(key).agg(F.max_by("status", F.struct(*order)).alias("status"), F.max("ts").alias("ts"))


def status_counts(events: DataFrame, label: str, statuses: tuple[str, ...] = ("RUNNING", "FAILED", "DISABLED", "DONE")) -> DataFrame:
    return events.groupBy(label).agg(*(F.count_if(F.col("status") == s).alias(s.lower()) for s in statuses))


def execution_time(events: DataFrame, key: str = "run") -> DataFrame:
    """Seconds from the last RUNNING before each DONE or FAILED; null where there is none. One row per ending."""
    before = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    started = F.last(F.when(F.col("status") == "RUNNING", F.col("ts")), ignorenulls=True).over(before)
    ended = events.withColumn("started", started).filter(F.col("status").isin("DONE", "FAILED"))
    return ended.withColumn("seconds", F.timestamp_diff("SECOND", F.col("started"), F.col("ts")))


def trailing_failures(events: DataFrame, key: str = "run", seconds: int = 3600) -> DataFrame:
    """Each failure with the failures of its key in the window up to it, itself included.

    Failures are summed by key and second first. Seconds fall into buckets as long as the window, and each serves its
    own bucket and the next, so that what is sorted in one place are 2 * (seconds + 1) sums at most, whatever a key's
    share of the rows.
    """
    bucket = lambda s: F.floor(s / (seconds + 1))
    failed = events.filter(F.col("status") == "FAILED").withColumn("__s", F.col("ts").cast("timestamp").cast("long"))
    sums = failed.groupBy(F.col(key).alias("__key"), F.col("__s").alias("__at")).agg(F.count(F.lit(1)).alias("__n"))
    each = sums.withColumn("__bucket", F.explode(F.array(bucket(F.col("__at")), bucket(F.col("__at")) + 1)))
    window = Window.partitionBy("__key", "__bucket").orderBy("__at").rangeBetween(-seconds, 0)
    counted = each.withColumn("failures", F.sum("__n").over(window)).filter(F.col("__bucket") == bucket(F.col("__at")))
    joined = failed.join(counted.select("__key", "__at", "failures"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__s") == F.col("__at")))
    return joined.drop("__s", "__key", "__at")


def disable_rule(events: DataFrame, key: str = "run", seconds: int = 3600, retry_count: int = 3, hard_timeout: int = 86400) -> DataFrame:
    """Each failure with whether it disables: enough failures in the window, or too long since the key's first."""
    first = events.filter(F.col("status") == "FAILED").groupBy(F.col(key).alias("__key")).agg(F.min("ts").alias("__first"))
    out = trailing_failures(events, key, seconds).join(first, F.col(key).eqNullSafe(F.col("__key")))
    out = out.withColumn("since_first", F.timestamp_diff("SECOND", F.col("__first"), F.col("ts"))).drop("__key", "__first")
    return out.withColumn("disables", (F.col("failures") >= retry_count) | (F.col("since_first") >= hard_timeout))


def disable_changes(events: DataFrame, key: str = "run", seconds: int = 3600, retry_count: int = 3, hard_timeout: int = 86400, persist: int = 86400, now: datetime | None = None) -> DataFrame:
    """(key, event_id, ts, change): when a key is DISABLED by its failures and ENABLED again.

    A failure disables if it is the ``retry_count``-th within the window, or the first one lies ``hard_timeout`` back.
    A disabled key counts no failures; it is enabled by the first event ``persist`` seconds later, as of then, or by
    an earlier DONE, and its failures are forgotten. With ``now`` a key without such an event is enabled by time alone,
    with a null event_id, as the stream does it. One stream goes through each key's events in order and keeps the
    failures of the window only, so that a key with most events is no group in memory. Only failures, successes and, of
    each stretch of other events, what enables a key can matter, but which do depends on what went before: a key's
    events are one sequence.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rule = Rule(seconds, retry_count, hard_timeout, persist)
    end = None if now is None else round((now.replace(tzinfo=now.tzinfo or UTC) - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
    if end is not None:
        rows = rows.filter(F.col("us") <= end)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(*(batch[c].to_pylist() for c in (key, "event_id", "status", "us")), strict=True))
        found = changes(rule, each, end)
        while some := list(islice(found, 10_000)):
            cols = zip(*some, strict=True)
            kinds = (key_type, pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[key, "event_id", "us", "change"])

    key_type = to_arrow_type(events.schema[key].dataType)
    ordered = rows.repartition(key).sortWithinPartitions(key, "us", "event_id")
    found = ordered.mapInArrow(scan, f"`{key}` {kind}, event_id long, us long, change string")
    return found.select(key, "event_id", F.timestamp_micros("us").cast(events.schema["ts"].dataType).alias("ts"), "change")


def owner_digest(events: DataFrame, owners: str, family: str) -> DataFrame:
    """Failures and disables per owner and family; an event of several owners counts for each."""
    each = events.withColumn("owner", F.explode(owners))
    return each.groupBy("owner", family).agg(F.count_if(F.col("status") == "FAILED").alias("failures"), F.count_if(F.col("status") == "DISABLED").alias("disables"))


def last_messages(events: DataFrame, key: str, message: str, keep: int = 1) -> DataFrame:
    """The last ``keep`` distinct messages per key; one seen again counts as of then."""
    seen = events.groupBy(key, message).agg(F.max("ts").alias("last_ts"))
    newest = Window.partitionBy(key).orderBy(F.desc("last_ts"), message)
    return seen.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= keep)


def digest_groups(digest: DataFrame, body: str, name: str, lines: int = 20) -> DataFrame:
    """Names that share a message's last lines, with summed counts, worst first."""
    tail = F.array_join(F.slice(F.split(body, "\n"), -F.least(F.lit(lines), F.size(F.split(body, "\n"))), lines), "\n")
    grouped = digest.groupBy(tail.alias("tail")).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias("names"), F.sum("failures").alias("failures"), F.sum("disables").alias("disables"), F.min(name).alias("first_name"))
    return grouped.orderBy(F.desc("failures"), F.desc("disables"), "first_name")


def outcomes(events: DataFrame, key: str = "run") -> DataFrame:
    """Per run: completed, already_done, ever_failed, failed, scheduling_error, still_pending."""
    had = lambda s: F.bool_or(F.col("status") == s)
    flags = events.groupBy(key).agg(had("DONE").alias("d"), had("PENDING").alias("p"), had("FAILED").alias("f"), had("UNKNOWN").alias("u"))
    return flags.select(
        key, (F.col("d") & F.col("p")).alias("completed"), (F.col("d") & ~F.col("p")).alias("already_done"), F.col("f").alias("ever_failed"),
        (F.col("f") & ~(F.col("d") & F.col("p"))).alias("failed"), F.col("u").alias("scheduling_error"), (F.col("p") & ~F.col("d") & ~F.col("f")).alias("still_pending"),
    )


def verdict(outcomes_: DataFrame, *by: str) -> DataFrame:
    """One word for all runs (or for each group): the first that applies, worst news first but for failures made good."""
    n = outcomes_.groupBy(*by).agg(*(F.count_if(c).alias(c) for c in ("ever_failed", "failed", "scheduling_error", "still_pending")))
    word = (
        F.when((F.col("ever_failed") > 0) & (F.col("failed") == 0) & (F.col("scheduling_error") == 0), "success with retry")
        .when((F.col("failed") > 0) & (F.col("scheduling_error") > 0), "failed and scheduling failed").when(F.col("failed") > 0, "failed")
        .when(F.col("scheduling_error") > 0, "scheduling failed").when(F.col("still_pending") > 0, "not run").otherwise("success")
    )
    return n.withColumn("verdict", word)


def search(tasks: DataFrame, name: str, terms: list[str], cap: int | None = None) -> DataFrame:
    """Rows whose name holds all terms in any case; above ``cap`` rows, only their number."""
    found = tasks.filter(F.forall(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.col(name)), F.lower(t)))) if terms else tasks
    if cap is None:
        return found
    few = found.limit(cap + 1).count() <= cap
    return found if few else found.agg(F.count(F.lit(1)).alias("total"))


def search_by_status(tasks: DataFrame, name: str, text: str) -> DataFrame:
    return tasks.filter(F.contains(F.col(name), F.lit(text))).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def ready(nodes: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """PENDING nodes all of whose dependencies are DONE; a missing one blocks. Edges: src depends on dst."""
    status = nodes.select(F.col(key).alias("dst"), F.col("status").alias("__s"))
    blocked = edges.join(status, "dst", "left").filter(F.coalesce(F.col("__s") != "DONE", F.lit(True))).select(F.col("src").alias(key))
    return nodes.filter(F.col("status") == "PENDING").join(blocked, key, "left_anti")


def dependency_status(nodes: DataFrame, edges: DataFrame, prefix: str, key: str = "id") -> DataFrame:
    """For nodes whose id has a prefix, how many dependencies have each status; absent ones are UNKNOWN."""
    mine = edges.filter(F.col("src").cast("string").startswith(prefix))
    status = nodes.select(F.col(key).alias("dst"), F.col("status").alias("dep_status"))
    return mine.join(status, "dst", "left").groupBy("src", F.coalesce("dep_status", F.lit("UNKNOWN")).alias("dep_status")).agg(F.count(F.lit(1)).alias("n"))


def priority_order(tasks: DataFrame, group: str, priority: str, time: str, key: str) -> DataFrame:
    """Rank in each group by priority, highest first, then earliest time, then key; a group may hold any share of the tasks."""
    return ranked(tasks, [group], [F.desc(priority), time, key])


def resource_usage(running: DataFrame, totals: DataFrame) -> DataFrame:
    """used, total (1 if not listed), consumers and free per resource of rows (resource, amount, consumer)."""
    used = running.groupBy("resource").agg(F.sum("amount").alias("used"), F.count_distinct("consumer").alias("consumers"))
    return used.join(totals, "resource", "left").withColumn("total", F.coalesce("total", F.lit(1.0))).withColumn("free", F.col("total") - F.col("used"))


def worker_table(tasks: DataFrame, workers: str) -> DataFrame:
    """running, pending and unique pending (only this worker can run it) per worker."""
    alone = F.size(workers) == 1
    each = tasks.withColumn("__alone", alone).withColumn("worker", F.explode(workers))
    is_ = lambda s: F.col("status") == s
    return each.groupBy("worker").agg(F.count_if(is_("RUNNING")).alias("running"), F.count_if(is_("PENDING")).alias("pending"), F.count_if(is_("PENDING") & F.col("__alone")).alias("unique_pending"))


def batches(tasks: DataFrame, fixed: list[str], batched: str, key: str, size: int) -> DataFrame:
    """Tasks equal on ``fixed`` in batches of at most ``size`` by key: the largest batched value and the number."""
    placed = ranked(tasks.select(*dict.fromkeys([*fixed, batched, key])), fixed, [key], "__place")
    return placed.withColumn("batch", F.floor((F.col("__place") - 1) / size)).groupBy(*fixed, "batch").agg(F.max(batched).alias(batched), F.count(F.lit(1)).alias("n"))


def silences(beats: DataFrame, key: str, seconds: int = 60) -> DataFrame:
    """Beats that come more than ``seconds`` after the one before, with the gap."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    gap = F.timestamp_diff("SECOND", before, F.col("ts"))
    return beats.withColumn("gap", gap).filter(F.col("gap") > seconds)


def fail_silent(runs: DataFrame, beats: DataFrame, now: Column, worker: str, seconds: int = 60) -> DataFrame:
    """Runs, the RUNNING ones of workers whose last beat is more than ``seconds`` old as FAILED."""
    gone = beats.groupBy(worker).agg(F.max("ts").alias("__last")).filter(F.timestamp_diff("SECOND", F.col("__last"), now) > seconds)
    marked = runs.join(gone.select(worker, F.lit(True).alias("__gone")), worker, "left")
    return marked.withColumn("status", F.when(F.col("__gone") & (F.col("status") == "RUNNING"), "FAILED").otherwise(F.col("status"))).drop("__gone")
