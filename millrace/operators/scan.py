"""Ranks within groups of any size: a prefix scan in two passes over range partitions.

Rows are range-partitioned and sorted by group and order, so that a group with most rows lies in many partitions. The
first pass numbers each group's rows within a partition. A group that crosses partitions is the last of one and the first
of the next, so that what the second pass needs is the number of rows of the first and last group of each partition: a
table of two rows a partition at most, summed along the partitions and carried over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import saved

_PLACE = "__rank long, __part int, __edge int"


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows in range partitions by group and order, sorted; a group of any size is dealt to several of them.

    Only rows equal in group and order stay together, so ``order`` should tell a group's rows apart.
    """
    keys = [*(F.col(f"`{c}`") for c in by), *(F.col(o) if isinstance(o, str) else o for o in order)]
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _changes(batch: pa.RecordBatch, last: pa.RecordBatch | None, by: Sequence[str]) -> np.ndarray:
    """Whether a row's group is another one than that of the row before; nulls are one value."""
    new = np.zeros(batch.num_rows, bool)
    for c in by:
        values = batch[c] if last is None else pa.concat_arrays([last[c], batch[c]])
        if pa.types.is_struct(values.type) or pa.types.is_list(values.type):
            raise TypeError(f"a group's column must not be nested: {c}")
        a, b = values[1:], values[:-1]
        differ = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.xor(a.is_null(), b.is_null()), pc.fill_null(pc.not_equal(a, b), False))
        if pa.types.is_floating(values.type):  # NaN is one value too
            differ = pc.and_not(differ, pc.and_(pc.fill_null(pc.is_nan(a), False), pc.fill_null(pc.is_nan(b), False)))
        new[int(last is None) :] |= differ.to_numpy(zero_copy_only=False)
    if last is None:
        new[0] = True
    return new


def _number(by: Sequence[str]):
    """Each row with its place in its group's run in this partition; __edge marks what the second pass looks at: 1 the
    last row of the first run, 2 that of the last one, 3 of a run that is both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, place, runs = None, 0, 0
        held: pa.RecordBatch | None = None  # the last row so far, whose mark is known when the next one comes

        def told(batch: pa.RecordBatch, rank: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank), pa.array(np.full(n, part, np.int32)), pa.array(edge.astype(np.int32))], names=[*batch.schema.names, "__rank", "__part", "__edge"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _changes(batch, last, by)
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            rank = np.where(start < 0, place + at + 1, at - start + 1).astype(np.int64)
            number = runs + np.cumsum(new)  # of the run, from 1
            if held is not None:
                ends = bool(new[0]) and runs == 1
                yield told(held, np.array([place], np.int64), np.array([int(ends)]))
            # A run's last row is known by the next row; that of the batch waits for it.
            closes = np.append(new[1:], False)
            yield told(batch.slice(0, n - 1), rank[:-1], (closes & (number == 1))[:-1])
            held = last = batch.slice(n - 1, 1)
            place, runs = int(rank[-1]), int(number[-1])
        if held is not None:
            yield told(held, np.array([place], np.int64), np.array([3 if runs == 1 else 2]))

    return run


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add ``name``, a row's number from 1 in its group by ``order``, as row_number would give it.

    Groups may hold any share of the rows. Null is a value of a group. Rows that are equal in group and order are
    numbered in no particular order. Columns of any type are carried; those of ``by`` must not be nested. The numbered
    rows are written once, so that a lost executor doesn't renumber them.
    """
    flat = T.StructType([*df.schema.fields, *T._parse_datatype_string(_PLACE).fields])
    numbered = saved(placed(df, by, order).mapInArrow(_number(by), flat))
    keys = [f"__by{i}" for i in range(len(by))]
    ends = numbered.filter("__edge > 0").select(*(F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)), F.col("__part").alias("__at"), F.col("__rank").alias("__rows"))
    # A group's rows in earlier partitions: a sum over as many rows as it has partitions.
    so_far = Window.partitionBy(*keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.sum("__rows").over(so_far).alias("__before")
    carried = ends.select(*keys, "__at", earlier).filter("__before > 0")
    on = reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)), F.col("__part") == F.col("__at"))
    joined = numbered.join(F.broadcast(carried), on, "left")  # two rows a partition at most
    rank = F.col("__rank") + F.coalesce("__before", F.lit(0))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), rank.alias(name))
