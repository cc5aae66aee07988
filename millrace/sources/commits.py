"""A commit log: what an update brings to several tables becomes visible at once, and only once.

An attempt writes its rows, and whatever is derived from them, into folders of its own, ``attempt=<id>`` under each
table. Then it creates the log's next entry, which names it. Entries are made by a rename that fails where the entry is
there already, so that of two writers who saw the same log one has to look again. Readers take the attempts that the log
names. An attempt that broke off, at whatever point, is in no entry and is never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .readers import _path, exists

ENTRY = "version long, attempt string"


def _name(version: int) -> str:
    return f"{version:020d}.json"


def last_version(spark: SparkSession, log: str) -> int:
    """The number of the log's last entry, 0 if it has none. Names are listed, no entry is read."""
    fs, folder = _path(spark, log)
    if not fs.exists(folder):
        return 0
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return max((int(n[:20]) for n in names if n[:20].isdigit() and n.endswith(".json")), default=0)


def add_entry(spark: SparkSession, log: str, version: int, attempt: str) -> bool:
    """Create an entry unless it is there; whether it was created. It is whole as soon as it can be seen."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    fs, made = _path(spark, f"{log}/.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({"version": version, "attempt": attempt}).encode()))
    out.close()
    place = _path(spark, f"{log}/{_name(version)}")[1]
    context = hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(made), fs.makeQualified(place), options)
    except Exception:
        if not fs.exists(place):
            raise
        fs.delete(made, False)
        return False
    return True


def committed(spark: SparkSession, log: str) -> DataFrame:
    """(version, attempt) of the log's entries."""
    if not exists(spark, log):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(log)


def read_committed(spark: SparkSession, table: str, log: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of committed attempts, and ``attempt``; other attempts' folders are pruned. A table without any attempt
    is empty if ``schema`` is given, and an error otherwise."""
    if schema is not None and not exists(spark, table):
        return spark.createDataFrame([], schema).withColumn("attempt", F.lit(None).cast("string"))
    reader = spark.read if schema is None else spark.read.schema(schema if isinstance(schema, str) else schema)
    try:
        rows = reader.option("basePath", table).parquet(table)
    except AnalysisException:
        if schema is None:
            raise
        return spark.createDataFrame([], schema).withColumn("attempt", F.lit(None).cast("string"))
    if "attempt" not in rows.columns:  # a schema was given, which has no partition column
        rows = spark.read.option("basePath", table).schema(T.StructType([*rows.schema.fields, T.StructField("attempt", T.StringType())])).parquet(table)
    return rows.join(committed(spark, log).select("attempt"), "attempt", "left_semi")


Parts = Mapping[str, Callable[[DataFrame], DataFrame]]


def apply_updates(batch: DataFrame, table: str, log: str, update_id: str = "update_id", parts: Parts | None = None, attempts: int = 20) -> bool:
    """Add the rows of updates that the log doesn't have yet; whether there were any.

    ``parts`` are further tables by path, each made from the rows that are added; with the rows and the update_ids they
    become visible by one entry. A failure at any point changes nothing that readers see. If another writer commits
    meanwhile, what it brought is left out and the attempt is made anew. A null update_id is an update of its own name.
    """
    spark = batch.sparkSession
    kind = f"`{update_id}` {batch.schema[update_id].dataType.simpleString()}"
    ids = f"{log}/_ids"
    for _ in range(attempts):
        version, attempt = last_version(spark, log), uuid.uuid4().hex
        place = lambda path: f"{path.rstrip('/')}/attempt={attempt}"  # noqa: E731, B023
        there = read_committed(spark, ids, log, kind).select(F.col(update_id).alias("__id")).distinct()
        batch.join(there, F.col(update_id).eqNullSafe(F.col("__id")), "left_anti").write.parquet(place(table))
        rows = spark.read.schema(batch.schema).parquet(place(table))
        if rows.isEmpty():
            fs, empty = _path(spark, place(table))
            fs.delete(empty, True)
            return False
        rows.select(update_id).distinct().write.parquet(place(ids))
        for path, make in (parts or {}).items():
            make(rows).write.parquet(place(path))
        if add_entry(spark, log, version + 1, attempt):
            return True
        for path in (table, ids, *(parts or {})):
            fs, old = _path(spark, place(path))
            fs.delete(old, True)
    raise RuntimeError(f"other writers were first {attempts} times: {log}")


def remove_uncommitted(spark: SparkSession, log: str, *tables: str) -> int:
    """Delete folders of attempts that no entry names; how many. For when no writer is at work."""
    named = {r.attempt for r in committed(spark, log).collect()}
    gone = 0
    for table in (*tables, f"{log}/_ids"):
        fs, folder = _path(spark, table)
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            name = status.getPath().getName()
            if name.startswith("attempt=") and name.removeprefix("attempt=") not in named:
                gone += bool(fs.delete(status.getPath(), True))
    return gone
