"""Documents and partitions that come whole, and JSON that is parsed once."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns
from millrace.operators import ranges
from millrace.plans.queries import QUERIES
from millrace.sources import readers, sinks
from millrace.sources.documents import FolderStore, send_documents


def stored(folder):
    return sorted((json.loads(line) for p in folder.glob("*.json") for line in p.read_text().splitlines()), key=lambda d: d["_id"])


def test_documents_are_sent_whole(spark, tmp_path):
    store = FolderStore(str(tmp_path))
    docs = spark.range(10, numPartitions=3).select(F.col("id").alias("_id"), F.when(F.col("id") > 0, F.col("id").cast("string")).alias("n"), F.lit("é").alias("t"))
    send_documents(docs, store, "i", "t", chunk=2, mapping={"n": "int"})
    assert stored(tmp_path)[:2] == [{"_id": 0, "t": "é", "_index": "i", "_type": "t"}, {"_id": 1, "n": 1, "t": "é", "_index": "i", "_type": "t"}]
    assert sorted(len(p.read_text().splitlines()) for p in tmp_path.glob("*.json")) == [1, 1, 2, 2, 2, 2]
    before = stored(tmp_path)
    broken = docs.withColumn("n", F.when(F.col("_id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        send_documents(broken, store, "i", "t", purge=True)
    assert stored(tmp_path) == before and not list(tmp_path.glob("_load*"))
    send_documents(docs.filter("_id < 2").withColumn("_index", F.lit("own")), store, "i", "t", purge=True)
    assert [(d["_id"], d["_index"]) for d in stored(tmp_path)] == [(0, "own"), (1, "own")]
    send_documents(docs.limit(0), store, "i", "t", purge=True)
    assert stored(tmp_path) == []


def test_a_failed_load_leaves_the_old_documents(spark, tmp_path):
    folder, markers = str(tmp_path / "docs"), str(tmp_path / "markers")
    docs = spark.range(3).select(F.col("id").alias("_id"))
    read = lambda: spark.read.json(folder).count()
    assert sinks.load_documents(docs, folder, markers, "one", "i", "t") and read() == 3
    broken = docs.withColumn("x", F.when(F.col("_id") == 2, F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        sinks.load_documents(broken, folder, markers, "two", "i", "t", purge=True)
    assert read() == 3 and not [p for p in (tmp_path / "docs").iterdir() if p.name.startswith("_staged")]
    assert sinks.load_documents(docs.limit(1), folder, markers, "two", "i", "t", purge=True, mapping={"_id": "string"}) and read() == 1
    assert spark.read.json(folder).first()["_id"] == "0" and not sinks.load_documents(docs, folder, markers, "two", "i", "t", purge=True) and read() == 1


def test_validated_rows_are_written_once(spark, tmp_path):
    path = str(tmp_path / "t")
    count = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        count.add(1)
        return x

    sinks.validate_and_publish(spark.range(10).select(counted("id").alias("id")), path, {"small": F.col("id") < 10})
    assert count.value == 10 and spark.read.parquet(path).count() == 10
    with pytest.raises(ValueError, match="small"):
        sinks.validate_and_publish(spark.range(12), path, {"small": F.col("id") < 10}, overwrite=True)
    assert spark.read.parquet(path).count() == 10 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_only_new_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).select("id", (F.col("id") % 3).alias("p")).write.partitionBy("p").parquet(path)
    kept = sorted(f.name for f in (tmp_path / "t/p=0").iterdir())
    sinks.replace_partitions(spark.createDataFrame([(100, 1), (101, 5)], "id long, p long"), path, "p")
    assert {(r.id, r.p) for r in spark.read.parquet(path).collect()} == {(100, 1), (101, 5), *((i, i % 3) for i in range(10) if i % 3 != 1)}
    assert kept == sorted(f.name for f in (tmp_path / "t/p=0").iterdir())


def test_json_is_parsed_once(spark):
    lines = ['{"a": 1, "b": {"c": [1, 2], "d": "x"}}', '{"a": 2.5, "e": null}', "no json", None, "[1]"]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    out = readers.json_by_paths(df, {"a": ("$.a", "double"), "d": "$.b.d", "second": ("$.b.c[1]", "int"), "b": "$.b"})
    assert [tuple(r) for r in out.collect()] == [(1.0, "x", 2, '{"c":[1,2],"d":"x"}'), (2.5, None, None, None), *[(None,) * 4] * 3]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1, plan
    found = readers.found_schema(df)
    assert {f.name: f.dataType.simpleString() for f in found.fields} == {"a": "decimal(21,1)", "b": "struct<c:array<bigint>,d:string>", "e": "string"}
    flat = columns.flatten_repeated(readers.found_documents(df.filter("value LIKE '{%'")))
    assert flat.columns == ["a", "b.c", "b.d", "e"] and sorted((float(r[0]), r[1] or 0, r[2]) for r in flat.collect()) == [(1.0, 1, "x"), (1.0, 2, "x"), (2.5, 0, None)]
    with pytest.raises(ValueError):
        readers.found_schema(df.filter("value = 'no json'"))


def test_functions_of_a_query(spark, tmp_path):
    spark.range(3).select(F.col("id").cast("string").alias("n")).createOrReplaceTempView("numbers_of_query")
    assert sinks.query_to_table(spark, "SELECT twice(n) AS t FROM numbers_of_query", str(tmp_path / "t"), functions={"twice": lambda s: s + s})
    assert sorted(r.t for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["00", "11", "22"]


def test_partitions_are_pruned(spark, sf, tmp_path):
    """A second dataset's ids prune the partitions of the first as the query runs; an interval's paths are all that is read."""
    out = QUERIES["f9_partitions_read"](spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and out.count() > 0
    paths = QUERIES["a5_interval_paths"](spark, sf)
    assert {f.rsplit("dt=", 1)[1][:10] for f in paths.inputFiles()} == {f"2024-01-{d:02d}" for d in range(5, 19)}


def test_partitions_of_a_catalog_table(spark, tmp_path):
    asked = spark.createDataFrame([("1", "a/b"), ("2", "c")], "p string, q string")
    spark.sql("DROP TABLE IF EXISTS parts_of_test")
    assert ranges.table_partitions(spark, "parts_of_test") is None
    assert [r.present for r in ranges.partitions_present(asked, None, ["q", "p"]).collect()] == [False, False]
    with pytest.raises(LookupError):
        ranges.partitions_present(asked, None, ["p"], missing_table="error")
    rows = spark.createDataFrame([(7, 1, "a/b"), (8, 1, "c")], "v int, p int, q string")
    rows.write.partitionBy("p", "q").format("parquet").option("path", str(tmp_path / "t")).saveAsTable("parts_of_test")
    there = ranges.table_partitions(spark, "parts_of_test")
    assert sorted(map(tuple, there.collect())) == [("1", "a/b"), ("1", "c")]
    assert {(r.q, r.present) for r in ranges.partitions_present(asked, there, ["q", "p"]).collect()} == {("a/b", True), ("c", False)}
    spark.sql("DROP TABLE parts_of_test")
