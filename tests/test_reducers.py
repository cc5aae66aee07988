"""Reducers over streams, table functions and counters of the job itself."""

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from millrace.operators import jobs


def batch(keys, values):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.int64())], names=["key", "v"])


def test_groups_are_cut_from_the_stream_as_they_are_read():
    given = [batch(["a", "a"], [1, 2]), batch([], []), batch(["a", "b", "c"], [3, 4, 5]), batch(["c"], [6]), batch([None, None], [7, 8])]
    read = []

    def stream():
        for i, b in enumerate(given):
            read.append(i)
            yield b

    seen = []
    for key, group in jobs._groups(stream(), "key"):
        values = [v for b in group for v in b["v"].to_pylist()]
        seen.append((key, values))
    assert seen == [("a", [1, 2, 3]), ("b", [4]), ("c", [5, 6]), (None, [7, 8])]
    read.clear()
    firsts = []
    for key, group in jobs._groups(stream(), "key"):
        firsts.append((key, next(group)["v"][0].as_py(), list(read)))
    assert firsts == [("a", 1, [0]), ("b", 4, [0, 1, 2]), ("c", 5, [0, 1, 2]), (None, 7, [0, 1, 2, 3, 4])]


def test_nan_and_null_are_keys():
    nan = float("nan")
    keys = pa.array([None, 1.0, nan, nan], pa.float64())
    one = pa.RecordBatch.from_arrays([keys, pa.array([1, 2, 3, 4])], names=["key", "v"])
    seen = [(str(k), [v for b in group for v in b["v"].to_pylist()]) for k, group in jobs._groups(iter([one, one.slice(2)]), "key")]
    assert seen == [("None", [1]), ("1.0", [2]), ("nan", [3, 4, 3, 4])]


def test_a_group_larger_than_a_worker_may_hold(spark):
    """Four million rows of 50 bytes are one key's: a worker that may use 100 MB more than it has reads them all."""
    rows = spark.range(0, 4_000_000, 1, 4).select(F.lit("hot").alias("key"), F.rpad(F.col("id").cast("string"), 50, "x").alias("v"), "id")

    def reducer(key, group):
        import resource

        pages = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
        resource.setrlimit(resource.RLIMIT_AS, (pages + (100 << 20), resource.RLIM_INFINITY))
        n = size = 0
        last = -1
        ordered = True
        for b in group:
            ids = b["id"].to_numpy()
            ordered &= bool((ids[1:] > ids[:-1]).all()) and int(ids[0]) > last
            last, n, size = int(ids[-1]), n + b.num_rows, size + pc.sum(pc.utf8_length(b["v"])).as_py()
        resource.setrlimit(resource.RLIMIT_AS, (resource.RLIM_INFINITY, resource.RLIM_INFINITY))
        yield pa.RecordBatch.from_pylist([{"key": key, "n": n, "size": size, "ordered": ordered}])

    [row] = jobs.reduce_sorted(rows, reducer, "key string, n long, size long, ordered boolean", "id").collect()
    assert tuple(row) == ("hot", 4_000_000, 200_000_000, True)


def test_combiner_and_early_stop(spark):
    rows = spark.range(0, 1000, 1, 8).select(F.when(F.col("id") % 2 == 0, "even").alias("key"), F.lit(1).cast("long").alias("v"))

    def combine(batches):
        for b in batches:
            t = pa.Table.from_batches([b]).group_by("key").aggregate([("v", "sum")])
            yield from pa.table({"key": t["key"], "v": t["v_sum"]}).to_batches()

    def total(key, group):
        batches = list(group)
        v = sum(pc.sum(b["v"]).as_py() for b in batches)
        yield pa.RecordBatch.from_pylist([{"key": key, "rows": sum(b.num_rows for b in batches), "v": v}], schema=pa.schema([("key", pa.string()), ("rows", pa.int64()), ("v", pa.int64())]))

    got = {r.key: (r.rows, r.v) for r in jobs.reduce_sorted(rows, total, "key string, rows long, v long", combiner=combine).collect()}
    assert got == {"even": (8, 500), None: (8, 500)}

    def first(key, group):
        yield next(group).slice(0, 1)

    df = jobs.reduce_sorted(rows, first, "key string, v long", parts=3)
    assert df.count() == 2 and df.rdd.getNumPartitions() == 3


def gaps():
    """A class of its own, which is sent to the workers whole."""

    class Gaps:
        """Each row's difference from the one before it in its group; the group's number of rows at its end."""

        def __init__(self):
            self.last, self.n, self.key = None, 0, None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            if "at" not in [f.name for f in rows.dataType.fields]:
                raise ValueError("a table with a column at is needed")
            return AnalyzeResult(schema=T.StructType([T.StructField("key", rows.dataType["k"].dataType), T.StructField("gap", T.LongType()), T.StructField("n", T.LongType())]))

        def eval(self, row):
            self.key, self.n = row["k"], self.n + 1
            if self.last is not None:
                yield self.key, row["at"] - self.last, None
            self.last = row["at"]

        def terminate(self):
            if self.n:
                yield self.key, None, self.n

    return Gaps


def test_mapper_over_a_table(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 1), ("b", 7), ("a", 2)], "k string, at long").repartition(3)
    out = jobs.map_records_udtf(rows, gaps(), ["k"], ["at"])
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([("a", 1, None), ("a", 3, None), ("a", None, 3), ("b", None, 1)], key=repr)
    with pytest.raises(Exception, match="a column at"):
        jobs.map_records_udtf(rows.withColumnRenamed("at", "other"), gaps(), ["k"])


def test_counters_of_the_write(spark, tmp_path):
    rows = spark.range(100)
    watched, told = jobs.observed(rows, "g", **{"even ones": F.col("id") % 2 == 0, "big": F.col("id") > 89})
    watched.write.parquet(str(tmp_path / "t"))
    assert {tuple(r) for r in told().collect()} == {("g", "even ones", 50), ("g", "big", 10)}
    assert spark.read.parquet(str(tmp_path / "t")).count() == 100
    plan = watched._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1 and "CollectMetrics" in plan
