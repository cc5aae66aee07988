"""Streaming counterparts of the batch queries. Event times must be timestamps with zone (UTC)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranges import Grid, expected, range_metrics
from ..sources.commits import apply_updates, read_committed
from ..sources.sinks import idempotent_load, read_marked


def failure_rate(events: DataFrame, key: str, window: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes", least: int = 1) -> DataFrame:
    """Sliding windows with at least ``least`` failures per key; rows later than the watermark are dropped."""
    failed = events.filter(F.col("status") == "FAILED")
    if events.isStreaming:
        failed = failed.withWatermark("ts", late)
    counts = failed.groupBy(F.window("ts", window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("failures"))
    return counts.filter(F.col("failures") >= least).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "failures")


def heartbeat_sessions(beats: DataFrame, key: str, gap: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions of a worker's beats; one ends when the worker is silent for the gap."""
    rows = beats.withWatermark("ts", late) if beats.isStreaming else beats
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("beats"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "beats")


def apply_once(updates: DataFrame, table: str, log: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Write each update_id once, whatever becomes of the stream: duplicates within the watermark are dropped, and the
    commit log leaves out what it has. A batch that is run again, and a stream that starts anew without its checkpoint,
    add nothing. Read with ``commits.read_committed``."""

    def load(batch: DataFrame, number: int) -> None:
        apply_updates(batch, table, log)

    once = updates.withWatermark("ts", late).dropDuplicatesWithinWatermark(["update_id"])
    return once.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _points(rows: DataFrame, grid: Grid) -> DataFrame:
    return rows.select(grid.floor(F.col("ts").cast("timestamp_ntz")).alias("ts")).distinct()


def ingest_updates(rows: DataFrame, table: str, log: str, grid: Grid, bounds: DataFrame, checkpoint: str, update_id: str = "update_id") -> StreamingQuery:
    """``ingest_with_metrics`` by update_id: rows, the grid points that they bring and the metrics after them
    (``table``-points, ``table``-metrics) become visible by one entry of the commit log, and no update twice.

    An update is what comes as a whole, such as a file by its path; all its rows must come in one batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def metrics(added: DataFrame) -> DataFrame:
            before = read_committed(spark, f"{table}-points", log, "ts timestamp_ntz").select("ts")
            return range_metrics(expected(bounds, grid), before.unionByName(_points(added, grid)))

        apply_updates(batch, table, log, update_id, {f"{table}-points": lambda added: _points(added, grid), f"{table}-metrics": metrics})

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_with_metrics(rows: DataFrame, table: str, metrics: str, grid: Grid, bounds: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append new rows (ts, ...) and after each batch the completeness of the expected range.

    Each batch also leaves the grid points that it brought, so that metrics are taken from points, of which there are
    few, and the table itself is never read again. Only batches that are marked count, and one that is run again
    overwrites its metrics. Batches are known by number, so the checkpoint must last; ``ingest_updates`` needs none.
    """

    def step(batch: DataFrame, number: int) -> None:
        _points(batch, grid).write.mode("overwrite").parquet(f"{table}-points/update_id=batch-{number}")
        idempotent_load(batch, table, f"{table}-markers", f"batch-{number}")
        present = read_marked(batch.sparkSession, f"{table}-points", f"{table}-markers").select("ts")
        range_metrics(expected(bounds, grid), present).write.mode("overwrite").parquet(f"{metrics}/batch={number}")

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
