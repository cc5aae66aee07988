"""What the registered queries can't show: files, databases, streams, and rules against plain Python."""

import bz2
import gzip
import hashlib
import json
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns
from millrace.operators import jobs, lineage, markers, ranges, runs
from millrace.plans.queries import QUERIES, events
from millrace.sources import readers, sinks
from millrace.streaming import jobs as streams

DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


def test_compressed_and_encoded_text(spark, tmp_path):
    lines = ["one", "zwei é", "three"]
    (tmp_path / "a.gz").write_bytes(gzip.compress("\r\n".join(lines).encode("latin-1")))
    (tmp_path / "b.bz2").write_bytes(bz2.compress("\n".join(lines).encode("latin-1")))
    for name in ("a.gz", "b.bz2"):
        assert [r.value for r in readers.read_text(spark, str(tmp_path / name), "ISO-8859-1").collect()] == lines
    kept = [r.value for r in readers.read_text(spark, str(tmp_path / "a.gz"), "ISO-8859-1", normalise=False).collect()]
    assert kept == ["one\r", "zwei é\r", "three"]


def test_listing_in_a_time_window(spark, tmp_path):
    for name in ("x.txt", "y.log"):
        (tmp_path / name).write_text("1")
    hour = timedelta(hours=1)
    at = lambda d: (datetime.now(UTC) + d).strftime("%Y-%m-%dT%H:%M:%S")
    names = lambda **o: sorted(r.path.rsplit("/", 1)[1] for r in readers.list_files(spark, str(tmp_path), **o).collect())
    assert names() == names(after=at(-hour)) == names(after=at(-hour), before=at(hour)) == ["x.txt", "y.log"]
    assert names(before=at(-hour)) == [] and names(glob="*.log") == ["y.log"]


def test_load_with_limits(spark, tmp_path):
    (tmp_path / "a.csv").write_text('junk\nmore\nhead\n1,x\n2,"y,z"\n3\n4,b,c\nq,w\n')
    load = lambda **o: sorted(map(tuple, readers.load_files(spark, str(tmp_path / "a.csv"), "csv", "a int, b string", skip=3, **o).collect()))
    assert load(max_bad=3) == [(1, "x"), (2, "y,z")]
    assert load(max_bad=2, jagged=True) == [(1, "x"), (2, "y,z"), (3, None)]
    assert load(max_bad=1, jagged=True, ignore_unknown=True) == [(1, "x"), (2, "y,z"), (3, None), (4, "b")]
    with pytest.raises(ValueError):
        load(max_bad=2)
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2, "z": 3}\n{bad\n')
    load = lambda **o: sorted(map(tuple, readers.load_files(spark, str(tmp_path / "b.json"), "json", "a int, b string", **o).collect()))
    assert load(max_bad=2) == [(1, None)] and load(max_bad=1, ignore_unknown=True) == [(1, None), (2, None)]
    with pytest.raises(ValueError):
        load()
    (tmp_path / "c.csv").write_text('a,b\n1,"two\nlines"\n')
    assert readers.load_files(spark, str(tmp_path / "c.csv"), "csv", "a int, b string", skip=1, multiLine=True).collect() == [(1, "two\nlines")]


def test_avro_paths_and_comment(spark):
    assert readers.avro_paths("/in/") == ["/in/*.avro"] and readers.avro_paths(["/a.avro", "/b"]) == ["/a.avro", "/b/*.avro"]
    with pytest.warns(UserWarning):
        assert not readers.comment_table(spark, "no_such_table", "doc")
    assert not readers.comment_table(spark, "no_such_table", None)


def test_layouts(spark):
    files = spark.createDataFrame([("/in/2020/02-28/03/x",), ("/in/2020/02-30/03/x",), ("/old/2019-01-05",)], "path string")
    assert [tuple(r) for r in readers.layout_matches(files, ["/%Y-%m-%d", "/%Y/%m-%d/%H"]).collect()] == [("/%Y-%m-%d", 1), ("/%Y/%m-%d/%H", 1)]
    assert [r[0] for r in files.select(readers.date_by_layout(F.col("path"), "/%Y/%m-%d/%H")).collect()] == [datetime(2020, 2, 28, 3), None, None]


def test_merge_in_order_into_one_file(spark, tmp_path):
    for i, n in enumerate((3, 2)):
        (tmp_path / f"p{i}.csv").write_text("a,b\n" + "".join(f"{i},{k}\n" for k in range(n)))
    merged = readers.merge_csv_parts(spark, [str(tmp_path / "p1.csv"), str(tmp_path / "p0.csv")])
    readers.write_merged(merged, str(tmp_path / "out"))
    [file] = (tmp_path / "out").glob("*.csv")
    assert file.read_text() == "a,b\n1,0\n1,1\n0,0\n0,1\n0,2\n"


def test_manifest_lists_what_is_there(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n")
    entry = lambda name, must: {"url": f"file://{tmp_path}/{name}", "mandatory": must}
    (tmp_path / "m.json").write_text(json.dumps({"entries": [entry("a.txt", True), entry("b.txt", False)]}))
    assert readers.read_manifest(spark, str(tmp_path / "m.json")).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"entries": [entry("a.txt", True), entry("b.txt", True)]}))
    with pytest.raises(FileNotFoundError):
        readers.read_manifest(spark, str(tmp_path / "m.json"))


def test_first_lines_and_generated(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\nb\nc\n")
    assert [r.value for r in readers.first_lines(spark, str(tmp_path / "x.txt"), 2).collect()] == ["a", "b"]
    assert readers.first_lines(spark, str(tmp_path / "x.txt")).count() == 3
    records = jobs.generated_records(spark, 50).collect()
    assert len(records) == 50 and {len(r.record) for r in records} == {100}
    assert jobs.generated_ratings(spark, 50).agg(F.sum("rating")).first()[0] == 50.0
    streams_ = jobs.generated_streams(spark, 1000)
    assert streams_.columns == ["user", "artist", "track"] and streams_.count() == 1000


def test_publish_over_what_is_there(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.publish(spark.range(3), path)
    with pytest.raises(FileExistsError):
        sinks.publish(spark.range(9), path)
    sinks.publish(spark.range(5), path, overwrite=True)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_copy_extract_unload(spark, tmp_path):
    sinks.publish(spark.range(3).withColumn("s", F.lit("a|b")), str(tmp_path / "t"))
    sinks.copy_table(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    table = spark.read.parquet(str(tmp_path / "u"))
    assert table.count() == 3
    sinks.extract(table, str(tmp_path / "csv"), compression="gzip")
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    sinks.unload(table, str(tmp_path / "un"))
    text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "un").glob("*.gz")).decode()
    assert sorted(text.split()) == [f'"{i}"|"a|b"' for i in range(3)]


def _jdbc(spark, url, table):
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).option("driver", DERBY).load()


def test_truncate_then_load(spark):
    url = "jdbc:derby:memory:trunc;create=true"
    for n in (5, 2):
        sinks.jdbc_load(spark.range(n).withColumnRenamed("id", "N"), url, "T", DERBY, truncate=n == 2)
    assert _jdbc(spark, url, "T").count() == 2


def test_database_load_once(spark):
    url, columns_ = "jdbc:derby:memory:once;create=true", [("N", "BIGINT"), ("S", "VARCHAR(20)")]
    rows = spark.range(10).select(F.col("id").alias("N"), F.lit("x").alias("S"))
    with pytest.raises(ValueError):
        sinks.jdbc_idempotent_load(rows, url, "T", DERBY, "u1", ["N", "S"])
    hooks = dict(before=("UPDATE T SET S = 'old'",), after=("UPDATE T SET S = 'new' WHERE S = 'x'",))
    assert [sinks.jdbc_idempotent_load(rows, url, "T", DERBY, u, columns_, **hooks) for u in ("u1", "u1", "u2")] == [True, False, True]
    assert sorted((r.S, r["count"]) for r in _jdbc(spark, url, "T").groupBy("S").count().collect()) == [("new", 10), ("old", 10)]
    assert {r.UPDATE_ID for r in _jdbc(spark, url, "TABLE_UPDATES").collect()} == {"u1", "u2"}
    with pytest.raises(Exception):  # noqa: B017
        sinks.jdbc_idempotent_load(rows, url, "T", DERBY, "u3", columns_, after=("UPDATE NOWHERE SET S = 1",))
    assert _jdbc(spark, url, "T").count() == 20 and _jdbc(spark, url, "TABLE_UPDATES").count() == 2


def test_toplist_to_database(spark, sf):
    url, columns_ = "jdbc:derby:memory:top;create=true", [("DATE_FROM", "DATE"), ("DATE_TO", "DATE"), ("CUSTKEY", "BIGINT"), ("N", "BIGINT")]
    orders = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderdate >= '1997-01-01' AND o_orderdate < '1997-02-01'")
    counts = jobs.count_by_key(orders, "o_custkey")
    done = [sinks.toplist_to_database(counts, "o_custkey", 10, "1997-01-01", "1997-02-01", url, "TOP", DERBY, columns_) for _ in range(2)]
    want = sorted((r.o_custkey, r.n) for r in QUERIES["f3_toplist"](spark, sf).collect())
    assert done == [True, False] and sorted((r.CUSTKEY, r.N) for r in _jdbc(spark, url, "TOP").collect()) == want


def test_document_sink(spark, tmp_path):
    docs, folder, marks = spark.range(25).select(F.col("id").alias("_id"), F.lit(None).cast("string").alias("x")), str(tmp_path / "d"), str(tmp_path / "m")
    assert [sinks.load_documents(docs.coalesce(1), folder, marks, u, "i", "t", chunk=10) for u in ("a", "a", "b")] == [True, False, True]
    files = list((tmp_path / "d").rglob("*.json"))
    assert len(files) == 6 and all(len(f.read_text().splitlines()) <= 10 for f in files)
    assert json.loads(files[0].read_text().splitlines()[0]).keys() == {"_id", "_index", "_type"}
    sinks.load_documents(docs, folder, marks, "c", "i", "t", purge=True)
    assert spark.read.json(folder).count() == 25


def test_query_to_table_once(spark, tmp_path):
    run = lambda: sinks.query_to_table(spark, "SELECT shout(:word) AS w", str(tmp_path / "q"), {"word": "a"}, {"shout": lambda s: s.upper()}, markers=str(tmp_path / "m"), update_id="u")
    assert [run(), run()] == [True, False] and spark.read.parquet(str(tmp_path / "q")).first().w == "A"


def test_cell_upsert(spark):
    table = spark.createDataFrame([(1, (1, "x")), (2, None)], "id int, s struct<a: int, b: string>")
    values = spark.createDataFrame([(1, "new"), (2, "two"), (3, "ins"), (4, "no")], "id int, value string")
    allowed = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    got = {r.id: r.s and tuple(r.s) for r in markers.upsert_cell(table, values, allowed, "id", "s.b").collect()}
    assert got == {1: (1, "new"), 2: (None, "two"), 3: (None, "ins")}


def test_stable_ids_are_those_of_json(spark):
    rows = [("plain", 'q"\\x'), ("é日\U0001f642", "a\nb\tc\x7f\x01"), ("x/y z", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", columns.stable_id("Fam", {"a": F.col("a"), "b": F.col("b")}).alias("id")).collect():
        want = hashlib.md5(json.dumps({"a": r.a, "b": r.b}, separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:10]
        assert r.id.endswith(want)


def test_multi_replace_takes_keys_in_order(spark):
    assert spark.range(1).select(columns.multi_replace(F.lit("abab aa"), {"ab": "x", "a": "y"})).first()[0] == "xx yy"


def test_disable_changes_against_plain_python(spark, sf):
    rule = dict(seconds=10 * 86400, retry_count=2, hard_timeout=20 * 86400, persist=5 * 86400)
    day = timedelta(1)
    want = set()
    by_run = {}
    for r in events(spark, sf).collect():
        by_run.setdefault(r.run, []).append((r.ts, r.event_id, r.status))
    for run, happened in by_run.items():
        failed, first, since = [], None, None
        for ts, event, status in sorted(happened):
            if since is not None and (ts - since >= 5 * day or status == "DONE"):
                want.add((run, event, min(ts, since + 5 * day), "ENABLED"))
                failed, first, since = [], None, None
            if status == "FAILED" and since is None:
                first = first or ts
                failed.append(ts)
                if sum(ts - x <= 10 * day for x in failed) >= 2 or ts - first >= 20 * day:
                    want.add((run, event, ts, "DISABLED"))
                    since = ts
    got = [(r.run, r.event_id, r.ts, r.change) for r in runs.disable_changes(events(spark, sf), **rule).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {c for *_, c in want} == {"ENABLED", "DISABLED"}


def test_runs_by_id_and_digest_tail(spark):
    tasks = spark.createDataFrame([(1, "s", "a"), (2, "s", "b"), (3, "t", "c")], "task_id int, stable string, name string")
    assert [r.name for r in runs.by_id(tasks, 2).collect()] == ["b"]
    assert {(r.stable, r.task_id, r.name) for r in runs.latest_by_stable_id(tasks, "stable").collect()} == {("s", 2, "b"), ("t", 3, "c")}
    body = "\n".join(str(i) for i in range(30))
    digest = spark.createDataFrame([(body, "n1", 1, 0), ("other\n" + body, "n2", 2, 1)], "body string, name string, failures int, disables int")
    [row] = runs.digest_groups(digest, "body", "name").collect()
    assert row.tail.split("\n") == [str(i) for i in range(10, 30)] and (row.names, row.failures, row.disables) == ("n1,n2", 3, 1)
    assert runs.search(tasks, "name", [], cap=2).collect() == [(3,)] and runs.search(tasks, "name", ["A"], cap=2).count() == 1


def test_lineage_with_cycles_and_caps(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (9, 5)], "src int, dst int")
    nodes = spark.createDataFrame([(1, "PENDING"), (2, "DONE"), (3, "PENDING"), (4, "FAILED"), (9, "RUNNING")], "id int, status string")
    assert {(r.id, r.severity) for r in lineage.upstream_severity(edges, nodes).collect()} == {(1, 0), (2, 0), (3, 3), (4, 0), (9, 0)}
    why = {r.id: r.asDict() for r in lineage.blocked_because(edges, nodes).collect()}
    assert why[1]["upstream_failure"] and why[1]["scheduling_error"] and not why[1]["run_by_other"] and not why[3]["not_run"]
    capped = lineage.closure(edges, nodes.filter("id = 1"), most=3)
    assert {(r.node, r.depth) for r in capped.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {r.node for r in lineage.on_paths(edges, nodes.filter("id = 1"), nodes.filter("id = 4")).collect()} == {1, 2, 3, 4}


def test_widened_range_and_label(spark):
    t = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp_ntz")
    low, high = ranges.widened(t(3), t(9), t(1), t(5))
    assert spark.range(1).select(low, high).first() == (datetime(2024, 1, 1), datetime(2024, 1, 9))
    points = ranges.expected_between(spark, ranges.Grid("day"), datetime(2024, 1, 1), datetime(2024, 1, 5))
    [row] = ranges.range_metrics(points, points.filter("day(ts) <> 3")).collect()
    assert (row.delay, row.complete_count, row.expected_count, row.label) == (2, 3, 4, "[2024-01-01 00:00, 2024-01-04 00:00]")


def test_stream_ingest_with_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 4)], "ts timestamp")
    bounds = spark.range(1).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("start"), F.lit(datetime(2024, 1, 6)).cast("timestamp_ntz").alias("stop"))
    args = (str(tmp_path / "t"), str(tmp_path / "metrics"), ranges.Grid("day"), bounds, str(tmp_path / "c"))
    for part in (rows.limit(2), rows.filter("day(ts) = 4")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        streams.ingest_with_metrics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), *args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "metrics")).orderBy("batch").collect()
    assert [(r.complete_count, r.expected_count) for r in got] == [(2, 5), (3, 5)]
    assert sinks.read_marked(spark, str(tmp_path / "t"), str(tmp_path / "t-markers")).count() == 3


def test_stream_sessions(spark, tmp_path):
    t = lambda s: datetime(2024, 1, 1, 0, 0) + timedelta(seconds=s)
    rows = spark.createDataFrame([("w", t(0)), ("w", t(50)), ("w", t(200)), ("v", t(10))], "worker string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.heartbeat_sessions(source, "worker").writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.worker, r.beats) for r in spark.sql("select * from sessions").collect()) == [("v", 1), ("w", 1), ("w", 2)]


def test_interval_of_paths_and_parts(spark, tmp_path):
    for d in (1, 2, 4):
        spark.range(d).write.parquet(str(tmp_path / f"2024-01-0{d}"))
    template = str(tmp_path / "%Y-%m-%d")
    assert readers.read_interval(spark, template, date(2024, 1, 1), date(2024, 1, 4)).count() == 3
    files = readers.list_files(spark, str(tmp_path), glob="*.parquet")
    usage = readers.dataset_usage(files, F.lit("all"))
    [row] = usage.collect()
    assert row.directories == 3 and readers.parts_reached(usage, row.files).first().reached and not readers.parts_reached(usage, row.files + 1).first().reached


def test_key_value_export(spark, tmp_path):
    lines = spark.createDataFrame([(1, "b\t1"), (2, "a\t2\tx"), (3, "b\t3"), (4, "none")], "n int, line string")
    sinks.export_key_values(lines, "line", "n", str(tmp_path / "kv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "kv")).orderBy("value").collect()] == ["a\t2\tx", "b\t3"]
