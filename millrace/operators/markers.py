"""Update markers and idempotent changes to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unmarked(batch: DataFrame, markers: DataFrame, *key: str) -> DataFrame:
    """Rows of a batch whose update isn't marked yet."""
    return batch.join(markers.select(*key), list(key), "left_anti")


def mark(markers: DataFrame, update_id: str, target_table: str, at: Column | None = None) -> DataFrame:
    """The markers with one more; a known update gets the new table and time."""
    new = markers.sparkSession.range(1).select(F.lit(update_id).alias("update_id"), F.lit(target_table).alias("target_table"), (F.current_timestamp() if at is None else at).alias("inserted"))
    return upsert(markers, new, "update_id", "inserted")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one latest by ``order``, the new one at a tie."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    columns = [c for c in both.columns if c not in (key, "__new")]
    best = both.groupBy(key).agg(F.max(F.struct(order, "__new", *(c for c in columns if c != order))).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in columns))


def live_markers(markers: DataFrame, now: Column, seconds: int, inserted: str = "inserted") -> DataFrame:
    """Markers younger than ``seconds``."""
    return markers.filter(F.timestamp_add("SECOND", F.lit(seconds), F.col(inserted)) > now)


def trim_history(markers: DataFrame, target: str, date: str, key: str, keep: int) -> DataFrame:
    """The newest ``keep`` markers per target; 0 keeps all.

    Each task drops all but its own newest ``keep`` before the shuffle (a group limit in the plan), so that a target with
    most markers sends that many from each task to one place.
    """
    if not keep:
        return markers
    newest = Window.partitionBy(target).orderBy(F.desc(date), F.desc(key))
    return markers.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= keep).drop("__n")


def marker_id(index: Column, doc_type: Column, update_id: Column) -> Column:
    return F.sha1(F.concat_ws(":", index, doc_type, update_id).cast("binary"))


def prune_then_load(old: DataFrame, new: DataFrame, column: str | None = None, since: Column | None = None) -> DataFrame:
    """Old rows with ``column`` below ``since`` (null stays, as in a DELETE), and the new ones. Both or neither."""
    if (column is None) != (since is None):
        raise ValueError("a column and a date go together")
    if column is not None:
        old = old.filter(~F.coalesce(F.col(column) >= since, F.lit(False)))
    return old.unionByName(new)


def upsert_field(table: DataFrame, values: DataFrame, allowed: DataFrame, key: str, field: str) -> DataFrame:
    """Set ``field`` for keys that are allowed, adding those not in the table yet."""
    new = values.join(allowed.select(key), key, "left_semi").select(key, F.col(field).alias("__value"), F.lit(True).alias("__set"))
    return table.join(new, key, "full_outer").withColumn(field, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(field))).drop("__value", "__set")


def upsert_cell(table: DataFrame, values: DataFrame, allowed: DataFrame, key: str, path: str, value: str = "value") -> DataFrame:
    """``upsert_field`` for a field inside a struct, named by its dotted path; what lies beside it stays."""
    root, _, inner = path.partition(".")
    new = values.join(allowed.select(key), key, "left_semi").select(key, F.col(value).alias("__value"), F.lit(True).alias("__set"))
    kind = table.schema[root].dataType
    blank = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields))
    whole = F.coalesce(F.col(root), blank).withField(inner, F.col("__value")).cast(kind)
    return table.join(new, key, "full_outer").withColumn(root, F.when(F.col("__set"), whole).otherwise(F.col(root))).drop("__value", "__set")


def ids_lacking(requested: DataFrame, table: DataFrame, key: str, field: str) -> DataFrame:
    return requested.select(key).join(table.filter(F.col(field).isNotNull()).select(key), key, "left_anti")


def count_gate(table: DataFrame, target: int) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("rows")).withColumn("ready", F.col("rows") == target)


def last_value_per_key(lines: DataFrame, text: str, order: str, sep: str = "\t") -> DataFrame:
    """Key and value split at the first separator; the last line of a key wins. Lines without one are left out."""
    parts = F.split(F.col(text), sep, 2)
    pairs = lines.filter(F.size(parts) == 2).select(parts[0].alias("key"), parts[1].alias("value"), F.col(order).alias("__at"))
    return pairs.groupBy("key").agg(F.max_by("value", F.struct("__at", "value")).alias("value"))
