"""Registered queries: one per operator, over the given tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import columns as col
from ..operators import jobs, lineage, markers, ranges, runs
from ..sources import readers, sinks
from ..sources.tables import scratch_path
from ..streaming import jobs as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: event_type of the events table as the status of a run.
STATUS = {"click": "RUNNING", "purchase": "DONE", "error": "FAILED", "view": "PENDING", "signup": "UNKNOWN"}
#: Errors of a value above this are disables.
DISABLING = 100
STATUS_SQL = f"CASE WHEN event_type = 'error' AND value > {DISABLING} THEN 'DISABLED' ELSE CASE event_type WHEN 'click' THEN 'RUNNING' WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'PENDING' ELSE 'UNKNOWN' END END"
EV = f"(SELECT event_id, ts, user_id AS run, props, value, {STATUS_SQL} AS status FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("run"), "props", "value", F.when((F.col("event_type") == "error") & (F.col("value") > DISABLING), "DISABLED").otherwise(named[F.col("event_type")]).alias("status"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").cast("date").alias("day"))


DAYS = "(SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS day FROM orders)"
BETWEEN = lambda c, a, b: (F.col(c) >= F.lit(a).cast("timestamp_ntz")) & (F.col(c) < F.lit(b).cast("timestamp_ntz"))


# ---- worked jobs -------------------------------------------------------------------------------------------------


@query("""SELECT DATE '1997-01-01' AS date_from, DATE '1997-02-01' AS date_to, o_custkey, count(*) AS n FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01'
    GROUP BY o_custkey ORDER BY n DESC, o_custkey DESC LIMIT 10""")
def f3_toplist(spark, sf):
    counts = jobs.count_by_key(table(spark, sf, "orders"), "o_custkey", BETWEEN("o_orderdate", "1997-01-01", "1997-02-01"))
    return jobs.toplist(counts, "o_custkey", 10, "1997-01-01", "1997-02-01")


@query("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def f1_count_by_key(spark, sf):
    return jobs.count_by_key(table(spark, sf, "orders"), "o_custkey", BETWEEN("o_orderdate", "1996-01-01", "1997-01-01"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id DESC LIMIT 10")
def f2_top10(spark, sf):
    return jobs.toplist(jobs.count_by_key(table(spark, sf, "events"), "user_id"), "user_id")


WORDS_SQL = "SELECT unnest(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) AS word FROM conversations"


@query(f"SELECT word, count(*) AS n FROM ({WORDS_SQL}) WHERE word <> '' GROUP BY 1")
def f4_word_count(spark, sf):
    return jobs.word_count(table(spark, sf, "conversations"))


@query(f"SELECT word, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS frequency FROM ({WORDS_SQL}) WHERE word <> '' GROUP BY 1")
def f5_word_frequency(spark, sf):
    return jobs.word_frequency(table(spark, sf, "conversations")).withColumn("frequency", F.round("frequency", 9))


@query("SELECT round(avg(l_quantity), 6) AS mean, round(sum(l_extendedprice), 2) AS total FROM lineitem")
def f6_column_statistics(spark, sf):
    return jobs.column_statistics(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("mean", 6).alias("mean"), F.round("total", 2).alias("total"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber")
def f7_global_sort(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")


@query()
def f8_item_factors(spark, sf):
    ratings = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.count(F.lit(1)).cast("float").alias("rating"))
    return jobs.item_factors(ratings)


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 0)")
def f9_second_read(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING' AND c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    orders = table(spark, sf, "orders")
    return jobs.second_read(orders, ids, "o_custkey").select(*orders.columns)


@query("SELECT doc_id AS _id, text, lang AS date, 'docs' AS _index, 'entry' AS _type FROM documents")
def f10_document_load(spark, sf):
    lines = table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("_id"), "text", F.col("lang").alias("date"))).alias("value"))
    return readers.documents(lines, "_id long, text string, date string", "docs", "entry").select("_id", "text", "date", "_index", "_type")


# ---- sources and sinks -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, nullif(split_part(p_name, ' ', 2), '') AS second FROM part")
def a2_split_fields(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *readers.split_fields(F.col("p_name"), "first", "second"))


@query("SELECT count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) < DATE '1996-04-01'")
def a5_interval_source(spark, sf):
    return table(spark, sf, "orders").filter(BETWEEN("o_orderdate", "1996-03-01", "1996-04-01")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'events' AS _index, 'event' AS _type FROM events")
def a12_json_documents(spark, sf):
    return readers.documents(table(spark, sf, "events"), "k long", "events", "event", "props", keep=("event_id",))


@query("SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1")
def a13_json_by_paths(spark, sf):
    return jobs.count_by_key(readers.json_by_paths(table(spark, sf, "events"), {"k": "$.k"}, "props"), "k")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') AS text FROM events")
def a13_typed_paths(spark, sf):
    """A number and its text by two paths of one parsed variant."""
    return readers.json_by_paths(table(spark, sf, "events"), {"k": ("$.k", "long"), "text": "$.k"}, "props", keep=("event_id",))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN user_id END AS "who.user", CASE WHEN event_id % 2 = 0 THEN event_type END AS "who.types" FROM events
    UNION ALL SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT), user_id, 'x' FROM events WHERE event_id % 2 = 0""")
def a17_found_schema(spark, sf):
    """Nested JSON of rows that lack fields: its schema is found by an aggregation, then its lists are unfolded."""
    rows = table(spark, sf, "events")
    who = F.when(F.col("event_id") % 2 == 0, F.struct(F.col("user_id").alias("user"), F.array("event_type", F.lit("x")).alias("types")))
    lines = rows.select("event_id", F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), who.alias("who"))).alias("value"))
    return col.flatten_repeated(readers.found_documents(lines, keep=("event_id",)))


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-19'")
def a5_interval_paths(spark, sf):
    """The events as a folder a day, of which an interval's are read by their paths."""
    from datetime import date

    folder = scratch_path(spark, "a5")
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    rows.withColumn("dt", F.col("day")).repartition("dt").write.partitionBy("dt").parquet(folder)
    return readers.read_interval(spark, folder + "/dt=%Y-%m-%d", date(2024, 1, 5), date(2024, 1, 19)).select("event_id", "day")


def _listing(spark, sf, name: str) -> str:
    """The events as text files, one a day and type; and a flag in each folder but that of errors."""
    folder = scratch_path(spark, name)
    rows = table(spark, sf, "events").select(F.concat_ws("\t", "event_id", "user_id", "value").alias("value"), "event_type", F.dayofmonth("ts").alias("day"))
    rows.repartition("event_type", "day").write.partitionBy("event_type", "day").option("compression", "gzip").text(folder)
    return folder


@query("SELECT event_id, user_id, value, event_type, CAST(day(ts) AS INTEGER) AS day FROM events")
def a1_delimited_files(spark, sf):
    """The events written as gzipped lines and read again, with the partitions that their paths tell."""
    folder = _listing(spark, sf, "a1")
    read = readers.read_delimited(spark, folder, "event_id long, user_id long, value double", keep=("event_type", "day"))
    return read.select("event_id", "user_id", "value", "event_type", F.col("day").cast("int").alias("day"))


@query("SELECT event_type AS dataset, count(DISTINCT day(ts)) AS directories, count(DISTINCT day(ts)) AS files, count(DISTINCT day(ts)) >= 29 AS reached FROM events GROUP BY 1")
def a9_dataset_usage(spark, sf):
    """Folders and files of each type's events, and whether they are as many as expected."""
    files = readers.list_files(spark, _listing(spark, sf, "a9"), glob="*.gz")
    usage = readers.dataset_usage(files, F.regexp_extract("path", "event_type=([^/]*)", 1))
    return readers.parts_reached(usage, 29).select("dataset", "directories", "files", "reached")


@query("SELECT p_partkey, p_name, p_type, p_size FROM part WHERE p_partkey % 50 <> 7")
def a14_reject_limit(spark, sf):
    """Parts as delimited lines, some of which have a size that is no number: read with a limit of bad lines."""
    folder = scratch_path(spark, "a14")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", F.when(F.col("p_partkey") % 50 == 7, F.lit("large")).otherwise(F.col("p_size").cast("string")).alias("p_size"))
    part.write.csv(folder)
    return readers.load_files(spark, folder, "csv", "p_partkey long, p_name string, p_type string, p_size int", max_bad=part.filter("p_size = 'large'").count())


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def b20_extract(spark, sf):
    """Customers extracted as gzipped bar-separated lines with a header, and read again."""
    folder = scratch_path(spark, "b20")
    sinks.extract(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), folder, sep="|", compression="gzip")
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").csv(folder, header=True, sep="|")


@query("SELECT l_suppkey, count(*) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def b21_unload(spark, sf):
    """Lines unloaded as quoted gzipped fields, and summed from the files."""
    folder = scratch_path(spark, "b21")
    sinks.unload(table(spark, sf, "lineitem").select("l_suppkey", "l_quantity"), folder)
    read = spark.read.schema("l_suppkey long, l_quantity double").csv(folder, sep="|")
    return read.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


UPDATES = "(SELECT CAST(o_orderkey AS VARCHAR) AS update_id, o_orderdate AS inserted, o_orderpriority AS target_table FROM orders)"


def updates(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("update_id"), F.col("o_orderdate").alias("inserted"), F.col("o_orderpriority").alias("target_table"))


@query(f"SELECT * FROM {UPDATES} u WHERE NOT EXISTS (SELECT 1 FROM {UPDATES} m WHERE m.update_id = u.update_id AND m.inserted < TIMESTAMP '1998-01-01')")
def b1_unmarked(spark, sf):
    rows = updates(spark, sf)
    return markers.unmarked(rows, rows.filter(F.col("inserted") < F.lit("1998-01-01").cast("timestamp_ntz")), "update_id").select("update_id", "inserted", "target_table")


@query("SELECT o_custkey, max(o_orderdate) AS o_orderdate, CAST(arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS BIGINT) AS o_orderkey FROM orders GROUP BY 1")
def b2_upsert(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    old, new = rows.filter("o_orderdate < '1998-01-01'"), rows.filter("o_orderdate >= '1998-01-01'")
    return markers.upsert(old, new, "o_custkey", "o_orderdate").select("o_custkey", "o_orderdate", "o_orderkey")


@query(f"SELECT update_id, inserted FROM {UPDATES} WHERE inserted + INTERVAL 86400000 SECOND > TIMESTAMP '2001-01-01'")
def b3_live_markers(spark, sf):
    return markers.live_markers(updates(spark, sf), F.lit("2001-01-01").cast("timestamp_ntz"), 86_400_000).select("update_id", "inserted")


@query(f"SELECT update_id, target_table FROM (SELECT *, row_number() OVER (PARTITION BY target_table ORDER BY inserted DESC, update_id DESC) AS n FROM {UPDATES}) WHERE n <= 20")
def b4_trim_history(spark, sf):
    return markers.trim_history(updates(spark, sf), "target_table", "inserted", "update_id", 20).select("update_id", "target_table")


@query("SELECT o_orderkey, sha1(o_orderpriority || ':' || o_orderstatus || ':' || CAST(o_orderkey AS VARCHAR)) AS id FROM orders")
def b5_marker_id(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", markers.marker_id(F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("id"))


BACKSLASH = "chr(92)"
ESCAPED_SQL = f"replace(html, {BACKSLASH}, {BACKSLASH} || {BACKSLASH})"
for _code, _letter in ((8, "b"), (9, "t"), (10, "n"), (11, "v"), (12, "f"), (13, "r")):
    ESCAPED_SQL = f"replace({ESCAPED_SQL}, chr({_code}), {BACKSLASH} || '{_letter}')"
#: The pages, and of every fifth one the html with a mark before each of the characters that are escaped.
MARKED_SQL = "(SELECT page_id, url, CASE WHEN page_id % 5 = 0 THEN replace(html, '<', chr(8) || chr(11) || chr(12) || chr(13) || '<') ELSE html END AS html FROM pages)"


@query(f"SELECT page_id, md5({ESCAPED_SQL}) AS escaped, nullif(split_part(url, ':', 1), 'http') AS scheme FROM {MARKED_SQL}")
def b6_escape(spark, sf):
    marked = F.when(F.col("page_id") % 5 == 0, F.replace("html", F.lit("<"), F.lit("\b\x0b\f\r<"))).otherwise(F.col("html"))
    rows = table(spark, sf, "pages").withColumn("html", marked)
    return rows.select("page_id", F.md5(col.escape_text(F.col("html"))).alias("escaped"), col.map_nulls(F.split("url", ":")[0], ["http"]).alias("scheme"))


@query("SELECT p_partkey, replace(replace(replace(p_type, 'A', '<1>'), 'E', 'A'), '<1>', 'E') AS swapped FROM part")
def b7_multi_replace(spark, sf):
    return table(spark, sf, "part").select("p_partkey", col.multi_replace(F.col("p_type"), {"A": "E", "E": "A"}).alias("swapped"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' UNION ALL SELECT o_orderkey, 0.0 FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def b10_prune_then_load(spark, sf):
    old = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    since = F.lit("1999-01-01").cast("timestamp_ntz")
    new = old.filter(F.col("o_orderdate") >= since).withColumn("o_totalprice", F.lit(0.0))
    return markers.prune_then_load(old, new, "o_orderdate", since).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN o_totalprice ELSE 0.0 END AS o_totalprice, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def b10_refresh_partitions(spark, sf):
    """Orders by year, of which the last years' folders are replaced."""
    folder = scratch_path(spark, "b10")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("year"))
    orders.write.partitionBy("year").parquet(folder)
    sinks.replace_partitions(orders.filter("year >= 1999").withColumn("o_totalprice", F.lit(0.0)), folder, "year")
    return spark.read.parquet(folder).select("o_orderkey", "o_totalprice", "year")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN (SELECT l_linestatus FROM lineitem WHERE l_quantity >= 50)")
def f9_partitions_read(spark, sf):
    """Orders by status, of which only those are read that another table lists (pruned as the query runs)."""
    folder = scratch_path(spark, "f9")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(folder)
    ids = table(spark, sf, "lineitem").filter("l_quantity >= 50").select(F.col("l_linestatus").alias("o_orderstatus")).distinct()
    return jobs.second_read(spark.read.parquet(folder), ids, "o_orderstatus").select("o_orderkey", "o_orderstatus")


@query("SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def b16_query(spark, sf):
    path = scratch_path(spark, "b16")

    @F.pandas_udf("string")
    def small_name(names: pd.Series) -> pd.Series:
        return names.str.lower()

    text = f"SELECT small_name(c_mktsegment) AS segment, count(*) AS n FROM parquet.`{sf}/customer.parquet` WHERE c_acctbal > :least GROUP BY 1"
    sinks.query_to_table(spark, text, path, {"least": 100}, {"small_name": small_name})
    return spark.read.parquet(path)


@query("SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings")
def b18_flatten_result(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.explode_outer(F.col("embedding").cast("array<double>")).alias("x"))


@query("""WITH c AS (SELECT conv_id, turn, role, string_split(role || ' ' || left(text, 40), ' ') AS words FROM conversations),
    g AS (SELECT conv_id, list(turn ORDER BY turn) AS turns, list(role ORDER BY turn) FILTER (WHERE turn > 0) AS later, list({'turn': turn, 'words': words} ORDER BY turn) AS said FROM c GROUP BY 1),
    one AS (SELECT conv_id, unnest(turns) AS turns, unnest(later) AS later, unnest(said) AS said FROM g)
    SELECT conv_id, turns AS "talk.turns", later AS "talk.later", said.turn AS "said.turn", unnest(said.words) AS "said.words" FROM one""")
def b18_flatten_repeated(spark, sf):
    """Conversations as one nested row each: two lists in a struct, one of them shorter, and a list of structs with lists."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.split(F.concat_ws(" ", "role", F.left("text", F.lit(40))), " ").alias("words"))
    told = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "words"))).alias("t"))
    later = F.transform(F.filter("t", lambda x: x["turn"] > 0), lambda x: x["role"])
    nested = told.select("conv_id", F.struct(F.transform("t", lambda x: x["turn"]).alias("turns"), later.alias("later")).alias("talk"), F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), x["words"].alias("words"))).alias("said"))
    return col.flatten_repeated(nested)


@query("SELECT split_part(l, chr(9), 1) AS key, arg_max(split_part(l, chr(9), 2), event_id) AS value FROM (SELECT event_id, CAST(user_id AS VARCHAR) || chr(9) || event_type AS l FROM events) GROUP BY 1")
def b22_last_value(spark, sf):
    lines = table(spark, sf, "events").select("event_id", F.concat_ws("\t", F.col("user_id").cast("string"), "event_type").alias("line"))
    return markers.last_value_per_key(lines, "line", "event_id")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'vip' ELSE c_name END AS c_name FROM customer")
def b24_upsert_field(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    values = customer.select("c_custkey", F.lit("vip").alias("c_name"))
    return markers.upsert_field(customer, values, customer.filter("c_mktsegment = 'BUILDING'"), "c_custkey", "c_name").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def b25_ids_lacking(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey")
    return markers.ids_lacking(asked, table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_totalprice")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01')")
def b25_ids_without_late_orders(spark, sf):
    asked = table(spark, sf, "customer").select("c_custkey")
    late = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(BETWEEN("o_orderdate", "2000-06-01", "2100-01-01"), F.col("o_totalprice")).alias("late"))
    return markers.ids_lacking(asked, late, "c_custkey", "late")


@query("SELECT count(*) AS rows, count(*) = 25 AS ready FROM nation")
def b26_count_gate(spark, sf):
    return markers.count_gate(table(spark, sf, "nation"), 25)


@query("SELECT count(*) FILTER (WHERE NOT l_quantity < 45) AS small, count(*) FILTER (WHERE NOT l_discount >= 0.02) AS discount FROM lineitem")
def b28_violations(spark, sf):
    return sinks.violations(table(spark, sf, "lineitem"), {"small": F.col("l_quantity") < 45, "discount": F.col("l_discount") >= 0.02})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"p.k\", user_id AS \"p.q.user\" FROM events")
def a17_flatten_struct(spark, sf):
    rows = table(spark, sf, "events")
    nested = rows.select("event_id", F.struct(F.from_json("props", "k long")["k"].alias("k"), F.struct(F.col("user_id").alias("user")).alias("q"), F.struct("ts").alias("attributes")).alias("p"))
    return nested.select(*col.flatten_struct(nested.schema))


@query("SELECT c_custkey, c_acctbal, 'loader' AS source, CAST(7 AS BIGINT) AS batch FROM customer")
def b11_metadata_columns(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return sinks.add_metadata(rows, {"source": ("string", F.lit("loader")), "batch": ("bigint", F.lit(7)), "c_acctbal": ("double", F.lit(0))})


@query("SELECT page_id AS _id, url, 'pages' AS _index, 'page' AS _type FROM pages")
def b23_document_sink(spark, sf):
    folder = scratch_path(spark, "b23")
    docs = table(spark, sf, "pages").select(F.col("page_id").alias("_id"), "url")
    sinks.load_documents(docs, f"{folder}/docs", f"{folder}/markers", "one", "pages", "page", chunk=500)
    return spark.read.schema("_id long, url string, _index string, _type string").json(f"{folder}/docs").select("_id", "url", "_index", "_type")


# ---- ranges ------------------------------------------------------------------------------------------------------

SPAN = "SELECT CAST(min(o_orderdate) AS TIMESTAMP) AS start, CAST(max(o_orderdate) AS TIMESTAMP) + INTERVAL 1 DAY AS stop FROM orders"
DAY_GRID = f"SELECT unnest(generate_series(start, stop - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS ts FROM ({SPAN})"
EV_SPAN = "SELECT min(ts) AS start, max(ts) AS stop FROM events"


def span(spark, sf):
    return table(spark, sf, "orders").agg(F.min("o_orderdate").alias("start"), (F.max("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("stop"))


def ev_span(spark, sf):
    return table(spark, sf, "events").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))


def _grid_sql(unit: str, step: str) -> str:
    return f"""SELECT ts FROM (SELECT unnest(generate_series(date_trunc('{unit}', start), stop, INTERVAL {step})) AS ts, start, stop FROM ({EV_SPAN}))
        WHERE ts >= start AND ts < stop"""


@query(DAY_GRID)
def c1_expected_days(spark, sf):
    return ranges.expected(span(spark, sf), ranges.Grid("day")).select("ts")


@query(_grid_sql("hour", "1 HOUR"))
def c2_expected_hours(spark, sf):
    return ranges.expected(ev_span(spark, sf), ranges.Grid("hour")).select("ts")


@query(_grid_sql("hour", "15 MINUTE"))
def c3_expected_minutes(spark, sf):
    return ranges.expected(ev_span(spark, sf), ranges.Grid("minute", 15)).select("ts")


@query(f"SELECT ts FROM (SELECT unnest(generate_series(date_trunc('month', start), stop, INTERVAL 1 MONTH)) AS ts, start, stop FROM ({SPAN})) WHERE ts >= start AND ts < date_trunc('month', stop)")
def c4_expected_months(spark, sf):
    return ranges.expected(span(spark, sf), ranges.Grid("month")).select("ts")


@query("""SELECT k, low, high, low > high AS empty FROM (SELECT k, greatest(start, TIMESTAMP '1998-06-01' - INTERVAL 100 DAY) AS low,
    least(stop, TIMESTAMP '1998-06-01') AS high FROM (SELECT o_custkey AS k, min(o_orderdate) AS start, max(o_orderdate) AS stop FROM orders GROUP BY 1))""")
def c5_bounds(spark, sf):
    sets = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("stop"))
    return ranges.window_bounds(sets, F.lit("1998-06-01").cast("timestamp_ntz"), "INTERVAL 100 DAY", "INTERVAL 0 DAY").select("k", "low", "high", "empty")


PRIORITIES = "(SELECT DISTINCT o_orderpriority AS k FROM orders)"
PRESENT = "(SELECT DISTINCT o_orderpriority AS k, date_trunc('day', o_orderdate) AS ts FROM orders)"
MISSING = f"SELECT k, ts FROM ({DAY_GRID}) CROSS JOIN {PRIORITIES} EXCEPT SELECT k, CAST(ts AS TIMESTAMP) FROM {PRESENT}"


def present(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).distinct()


def missing_days(spark, sf):
    kinds = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count(F.lit(1)))
    asked = kinds.select("k").join(F.broadcast(span(spark, sf)))  # one row
    return ranges.missing(ranges.expected(asked, ranges.Grid("day")).select("k", "ts"), present(spark, sf), "k", "ts")


@query(MISSING)
def c6_missing(spark, sf):
    return missing_days(spark, sf)


@query("SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def c7_bulk_complete(spark, sf):
    asked = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return ranges.complete(asked, table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")), "day")


@query("""SELECT day, bool_and(EXISTS (SELECT 1 FROM orders o WHERE CAST(o.o_orderdate AS DATE) = day AND o.o_orderpriority = k)) AS complete
    FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) CROSS JOIN (SELECT unnest(['1-URGENT', '2-HIGH']) AS k) GROUP BY 1""")
def c8_multi_output(spark, sf):
    listed = days(spark, sf)
    asked = listed.select("day").distinct().withColumn("k", F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))))
    return ranges.complete_outputs(asked, listed, "day", "k")


@query("SELECT c_custkey, coalesce((SELECT bool_and(o_orderstatus <> 'O') FROM orders WHERE o_custkey = c_custkey), true) AS complete FROM customer")
def c9_wrapper_complete(spark, sf):
    members = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") != "O").alias("done"))
    return ranges.wrapper_complete(table(spark, sf, "customer"), members, "c_custkey", "done")


@query(f"SELECT * FROM (SELECT DISTINCT ts FROM ({MISSING}) ORDER BY ts DESC LIMIT 50) ORDER BY ts DESC")
def c11_backfill(spark, sf):
    return ranges.choose_backfill(missing_days(spark, sf).select("ts").distinct(), 50, reverse=True)


@query(f"""WITH m AS (SELECT q.k, e.ts, p.ts IS NOT NULL AS here FROM ({DAY_GRID}) e CROSS JOIN {PRIORITIES} q LEFT JOIN {PRESENT} p ON CAST(p.ts AS TIMESTAMP) = e.ts AND p.k = q.k),
    f AS (SELECT k, min(ts) FILTER (WHERE NOT here) AS first FROM m GROUP BY 1)
    SELECT k, count(*) FILTER (WHERE ts >= first) AS delay, count(*) FILTER (WHERE here) AS complete_count, count(*) FILTER (WHERE here) / count(*) AS complete_fraction, count(*) AS expected_count,
      '[' || strftime(min(ts), '%Y-%m-%d %H:%M') || ', ' || strftime(max(ts), '%Y-%m-%d %H:%M') || ']' AS label FROM m JOIN f USING (k) GROUP BY 1""")
def c12_range_metrics(spark, sf):
    kinds = days(spark, sf).select("k").distinct()
    asked = ranges.expected(kinds.join(F.broadcast(span(spark, sf))), ranges.Grid("day"))  # one row
    return ranges.range_metrics(asked.select("k", "ts"), present(spark, sf), "k")


#: Order dates as folders of an hour, and line ship dates as files of a day; every third day has its flag.
@query("SELECT o_orderkey, o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) AS ts FROM orders")
def c10_date_from_path(spark, sf):
    hour = F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0")
    path = F.concat(F.lit("/in/k"), F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "/yyyy/MM-dd/"), hour, F.lit("/part"))
    return table(spark, sf, "orders").select("o_orderkey", readers.date_by_layout(path, "/%Y/%m-%d/%H/").alias("ts"))


SHIPPED = "(SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)"


def day_files(spark, sf):
    shipped = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    name = F.explode(F.array_compact(F.array(F.lit("part-0"), F.when(F.dayofmonth("day") % 3 == 0, F.lit("_SUCCESS")))))
    return shipped.select("day", name.alias("name")).select(F.concat(F.lit("/out/"), F.col("day").cast("string"), F.lit("/"), F.col("name")).alias("path"))


@query(f"SELECT CAST(day AS VARCHAR) AS partition FROM {SHIPPED}")
def c19_partitions_with_files(spark, sf):
    return readers.partitions_with_files(day_files(spark, sf), F.split("path", "/")[2], "^_")


@query(f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), r AS (
      SELECT 'path' AS kind, '/out/' || day AS target, day FROM d UNION ALL SELECT 'flag', '/out/' || day || '/', day FROM d UNION ALL SELECT 'partition', CAST(day AS VARCHAR), day FROM d UNION ALL SELECT 'table', CAST(day AS VARCHAR), day FROM d)
    SELECT kind, target, CASE kind WHEN 'path' THEN day IN (SELECT day FROM {SHIPPED}) WHEN 'flag' THEN day IN (SELECT day FROM {SHIPPED}) AND day(day) % 3 = 0
      WHEN 'partition' THEN day IN (SELECT CAST(ts AS DATE) FROM events) ELSE false END AS ready FROM r""")
def c22_external_readiness(spark, sf):
    day = days(spark, sf).select(F.col("day").cast("string").alias("day")).distinct()
    each = F.array(F.struct(F.lit("path").alias("kind"), F.concat(F.lit("/out/"), "day").alias("target")), F.struct(F.lit("flag").alias("kind"), F.concat(F.lit("/out/"), "day", F.lit("/")).alias("target")), *(F.struct(F.lit(k).alias("kind"), F.col("day").alias("target")) for k in ("partition", "table")))
    asked = day.select(F.inline(each))
    partitions = table(spark, sf, "events").select(F.col("ts").cast("date").cast("string").alias("target"))
    tables = table(spark, sf, "nation").select(F.col("n_name").alias("target"))
    return ranges.external_readiness(asked, day_files(spark, sf), tables, partitions).select("kind", "target", "ready")


@query("""SELECT 'table' AS kind, name AS target, name IN (SELECT r_name FROM region) AS ready FROM (SELECT DISTINCT r_name AS name FROM region UNION SELECT n_name FROM nation)
    UNION ALL SELECT 'partition', 'p=' || p_size, p_size IN (SELECT p_size FROM part WHERE p_brand = 'Brand#1') FROM (SELECT DISTINCT p_size FROM part)""")
def c22_tables_and_partitions(spark, sf):
    """Tables and partitions that are there, and others."""
    regions, part = table(spark, sf, "region").select(F.col("r_name").alias("target")), table(spark, sf, "part")
    named = lambda rows: rows.select(F.concat(F.lit("p="), F.col("p_size").cast("string")).alias("target")).distinct()
    asked = regions.unionByName(table(spark, sf, "nation").select(F.col("n_name").alias("target"))).distinct().select(F.lit("table").alias("kind"), "target")
    asked = asked.unionByName(named(part).select(F.lit("partition").alias("kind"), "target"))
    return ranges.external_readiness(asked, spark.createDataFrame([], "path string"), regions, named(part.filter("p_brand = 'Brand#1'"))).select("kind", "target", "ready")


ASKED = f"(SELECT DISTINCT p.k, CAST(g.ts AS DATE) AS day FROM ({DAY_GRID}) g CROSS JOIN {PRIORITIES} p)"


def asked_days(spark, sf):
    kinds = days(spark, sf).select("k").distinct()
    return ranges.expected(kinds.join(F.broadcast(span(spark, sf))), ranges.Grid("day")).select("k", F.col("ts").cast("date").alias("day"))


def _last_sql(low: str, high: str) -> str:
    return f"(SELECT a.k, a.day, max(p.day) AS found_day FROM {ASKED} a LEFT JOIN (SELECT DISTINCT * FROM {DAYS}) p ON p.k = a.k AND p.day <= a.day - {high} AND p.day > a.day - {low} GROUP BY 1, 2)"


@query(f"SELECT k, day, CAST(coalesce(found_day, day - 13) AS DATE) AS snapshot, found_day IS NOT NULL AS found FROM {_last_sql('14', '0')}")
def c14_latest_snapshot(spark, sf):
    return ranges.latest_snapshot(asked_days(spark, sf), days(spark, sf), "k")


@query("SELECT event_id, ts - INTERVAL 1 HOUR AS ts FROM events")
def c15_previous_period(spark, sf):
    return ranges.previous_period(table(spark, sf, "events").select("event_id", "ts"), "HOUR", "ts")


@query(f"SELECT k, day, found_day AS previous FROM {_last_sql('11', '1')}")
def c16_previous_complete(spark, sf):
    return ranges.previous_complete(asked_days(spark, sf), days(spark, sf), "k")


@query(f"""WITH r AS (SELECT k, day, day - CAST(row_number() OVER (PARTITION BY k ORDER BY day) AS INTEGER) AS g FROM (SELECT DISTINCT * FROM {DAYS}))
    SELECT k, min(day) AS first, max(day) AS last, count(*) AS n,
      CASE WHEN count(*) > 3 THEN CAST(min(day) AS VARCHAR) || '...' || CAST(max(day) AS VARCHAR) ELSE string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) END AS label
    FROM r GROUP BY k, g""")
def c17_islands(spark, sf):
    return ranges.islands(days(spark, sf), "k")


@query("""SELECT o_orderpriority, o_orderstatus, 'o_orderpriority=' || o_orderpriority || '/o_orderstatus=' || o_orderstatus AS key,
    EXISTS (SELECT 1 FROM orders o WHERE o.o_orderpriority = r.o_orderpriority AND o.o_orderstatus = r.o_orderstatus AND o.o_orderdate >= TIMESTAMP '2001-07-25') AS present
    FROM (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders) r""")
def c18_partitions_present(spark, sf):
    orders = table(spark, sf, "orders")
    asked = orders.select("o_orderpriority", "o_orderstatus").distinct()
    return ranges.partitions_present(asked, orders.filter("o_orderdate >= '2001-07-25'"), ["o_orderstatus", "o_orderpriority"]).select("o_orderpriority", "o_orderstatus", "key", "present")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS rows, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 0 AS present FROM customer")
def c20_partition_rows(spark, sf):
    return ranges.partition_rows(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


# ---- scalar functions --------------------------------------------------------------------------------------------

ODATE = "CAST(o_orderdate AS DATE)"
WEEK_SQL = f"CAST(isoyear({ODATE}) AS VARCHAR) || '-W' || lpad(CAST(week({ODATE}) AS VARCHAR), 2, '0')"


def odates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


def _texts(day: Column) -> Column:
    iso = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), day), F.weekofyear(day))
    text = F.date_format(day, "yyyy-MM-dd")
    return F.array(F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM"), iso, text, F.concat_ws("-", text, F.date_format(F.date_add(day, 10), "yyyy-MM-dd")), F.lit("2001-W60"), F.lit("x"))


INTERVALS_SQL = f"""(
    SELECT o_orderkey, 'year' AS kind, strftime({ODATE}, '%Y') AS text, date_trunc('year', {ODATE}) AS a, date_trunc('year', {ODATE}) + INTERVAL 1 YEAR AS b FROM orders
    UNION ALL SELECT o_orderkey, 'month', strftime({ODATE}, '%Y-%m'), date_trunc('month', {ODATE}), date_trunc('month', {ODATE}) + INTERVAL 1 MONTH FROM orders
    UNION ALL SELECT o_orderkey, 'week', {WEEK_SQL}, date_trunc('week', {ODATE}), date_trunc('week', {ODATE}) + INTERVAL 7 DAY FROM orders
    UNION ALL SELECT o_orderkey, 'date', strftime({ODATE}, '%Y-%m-%d'), {ODATE}, {ODATE} + INTERVAL 1 DAY FROM orders
    UNION ALL SELECT o_orderkey, 'custom', strftime({ODATE}, '%Y-%m-%d') || '-' || strftime({ODATE} + 10, '%Y-%m-%d'), {ODATE}, {ODATE} + INTERVAL 10 DAY FROM orders)"""


def intervals(spark, sf):
    # Parsed where they are exploded: a later filter on ``i`` isn't pushed below and parses no text again.
    parsed = F.transform(_texts(F.col("day")), lambda text: F.struct(text.alias("text"), cal.parse_interval(text).alias("i")))
    return odates(spark, sf).select("o_orderkey", F.inline(parsed))


@query(f"""SELECT o_orderkey, kind, text, CAST(a AS DATE) AS date_a, CAST(b AS DATE) AS date_b FROM {INTERVALS_SQL}
    UNION ALL SELECT o_orderkey, NULL, unnest(['2001-W60', 'x']), NULL, NULL FROM orders""")
def d1_parse_interval(spark, sf):
    return intervals(spark, sf).select("o_orderkey", "i.kind", "text", "i.date_a", "i.date_b")


@query(f"SELECT o_orderkey, text, text AS again FROM {INTERVALS_SQL}")
def d2_interval_text(spark, sf):
    return intervals(spark, sf).filter("i IS NOT NULL").select("o_orderkey", "text", cal.interval_text(F.col("i")).alias("again"))


@query(f"SELECT o_orderkey, CAST(date_trunc('week', {ODATE}) AS DATE) AS week_a, CAST(date_trunc('month', {ODATE}) AS DATE) AS month_a, CAST(date_trunc('year', {ODATE}) + INTERVAL 1 YEAR AS DATE) AS year_b FROM orders")
def d3_interval_of(spark, sf):
    day = F.col("day")
    return odates(spark, sf).select("o_orderkey", cal.interval_of("week", day)["date_a"].alias("week_a"), cal.interval_of("month", day)["date_a"].alias("month_a"), cal.interval_of("year", day)["date_b"].alias("year_b"))


@query(f"""SELECT o_orderkey, CAST(unnest(generate_series(CAST(date_trunc('week', {ODATE}) AS TIMESTAMP), date_trunc('week', {ODATE}) + INTERVAL 6 DAY, INTERVAL 1 DAY)) AS DATE) AS day, 168 AS hours FROM orders""")
def d4_expand(spark, sf):
    week = cal.interval_of("week", F.col("day"))
    # Hours are told before days are exploded: once an order, not once a day.
    rows = odates(spark, sf).select("o_orderkey", week.alias("i")).withColumn("hours", F.size(cal.interval_hours(F.col("i"))))
    return rows.select("o_orderkey", F.explode(cal.interval_days(F.col("i"))).alias("day"), "hours")


@query(f"SELECT o_orderkey, text, CASE WHEN kind <> 'custom' THEN CAST(b AS DATE) END AS next_a, CASE WHEN kind <> 'custom' THEN CAST(a AS DATE) END AS prev_b FROM {INTERVALS_SQL}")
def d5_prev_next(spark, sf):
    i = F.col("i")
    return intervals(spark, sf).filter("i IS NOT NULL").select("o_orderkey", "text", cal.interval_next(i)["date_a"].alias("next_a"), cal.interval_prev(i)["date_b"].alias("prev_b"))


@query(f"SELECT o_orderkey, kind, (DATE '1998-05-05' >= a AND DATE '1998-05-05' < b) AS holds, CASE WHEN kind = 'month' THEN a < DATE '1998-05-01' END AS before FROM {INTERVALS_SQL}")
def d6_contains(spark, sf):
    i, may = F.col("i"), cal.interval_of("month", F.lit("1998-05-05").cast("date"))
    return intervals(spark, sf).filter("i IS NOT NULL").select("o_orderkey", "i.kind", cal.interval_contains(i, F.lit("1998-05-05").cast("date")).alias("holds"), cal.interval_before(i, may).alias("before"))


@query(f"""SELECT o_orderkey, {ODATE} - CAST(((date_diff('day', DATE '1998-01-01', {ODATE}) % 7) + 7) % 7 AS INTEGER) AS by7,
    CAST(date_trunc('quarter', {ODATE}) AS DATE) AS by_quarter, make_date(year({ODATE}) // 2 * 2, 1, 1) AS by_2years FROM orders""")
def d7_clamp_date(spark, sf):
    day = F.col("day")
    return odates(spark, sf).select("o_orderkey", cal.clamp_date(day, "day", 7, "1998-01-01").alias("by7"), cal.clamp_date(day, "month", 3).alias("by_quarter"), cal.clamp_date(day, "year", 2).alias("by_2years"))


@query("SELECT event_id, time_bucket(INTERVAL 900 SECOND, ts, TIMESTAMP '2024-01-15 00:07:00') AS clamped FROM events")
def d8_clamp_timestamp(spark, sf):
    return table(spark, sf, "events").select("event_id", cal.clamp_timestamp(F.col("ts"), 900, "2024-01-15 00:07:00").alias("clamped"))


@query(f"SELECT o_orderkey, {ODATE} + 3 AS d, CAST({ODATE} + INTERVAL 2 MONTH AS DATE) AS m, CAST({ODATE} + INTERVAL 1 YEAR AS DATE) AS y FROM orders")
def d9_next_on_grid(spark, sf):
    day = F.col("day")
    return odates(spark, sf).select("o_orderkey", cal.next_on_grid(day, "day", 3).alias("d"), cal.next_on_grid(day, "month", 2).alias("m"), cal.next_on_grid(day, "year").alias("y"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H') AS hour, strftime(ts, '%Y-%m-%dT%H%M') AS minute, date_trunc('minute', ts) AS again FROM events")
def d10_typed_dates(spark, sf):
    ts = F.col("ts")
    old = F.date_format(ts, "yyyy-MM-dd'T'HH'H'mm")
    return table(spark, sf, "events").select("event_id", cal.format_typed_date(ts, "hour").alias("hour"), cal.format_typed_date(ts, "minute").alias("minute"), cal.parse_typed_date(old, "minute").cast("timestamp_ntz").alias("again"))


@query("SELECT p_partkey, p_size * 86400 + 7200 AS iso, p_size * 604800 + 180 AS words, p_size AS bare, CAST(NULL AS BIGINT) AS bad FROM part")
def d11_parse_duration(spark, sf):
    n = F.col("p_size").cast("string")
    made = lambda *parts: cal.parse_duration(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))
    return table(spark, sf, "part").select("p_partkey", made("P", n, "DT2H").alias("iso"), made(n, " weeks 3 minutes").alias("words"), made(n).alias("bare"), made(n, " days or so").alias("bad"))


@query("""SELECT p_partkey, CASE WHEN s = 0 THEN '0 s' ELSE concat_ws(' ', CASE WHEN s // 604800 > 0 THEN (s // 604800) || ' w' END, CASE WHEN s % 604800 // 86400 > 0 THEN (s % 604800 // 86400) || ' d' END,
    CASE WHEN s % 86400 // 3600 > 0 THEN (s % 86400 // 3600) || ' h' END, CASE WHEN s % 3600 // 60 > 0 THEN (s % 3600 // 60) || ' m' END, CASE WHEN s % 60 > 0 THEN (s % 60) || ' s' END) END AS text
    FROM (SELECT p_partkey, p_partkey * 7919 AS s FROM part)""")
def d12_duration_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", cal.duration_text(F.col("p_partkey") * 7919).alias("text"))


@query("SELECT event_id, TRY_CAST(regexp_replace(props, '[^0-9x]', '', 'g') AS BIGINT) AS n, TRY_CAST(event_type AS BIGINT) AS bad, event_type = 'click' AS flag FROM events")
def d13_typed_parse(spark, sf):
    digits = F.regexp_replace("props", "[^0-9x]", "")
    flag = F.when(F.col("event_type") == "click", "TRUE").otherwise("False")
    return table(spark, sf, "events").select("event_id", col.parse_typed(digits, "int", True).alias("n"), col.parse_typed(F.col("event_type"), "int").alias("bad"), col.parse_typed(flag, "bool").alias("flag"))


@query("SELECT l_orderkey, l_linenumber, l_quantity >= 10 AND l_quantity < 20 AS half_open, l_quantity > 10 AND l_quantity <= 20 AS other FROM lineitem")
def d14_range_rule(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", col.in_range(q, 10, 20).alias("half_open"), col.in_range(q, 10, 20, True, False).alias("other"))


@query("""SELECT o_orderkey, o_orderkey % 4 = 0 OR (o_orderstatus IN ('F', 'O') AND (o_orderkey % 4 = 1 OR o_orderpriority = '1-URGENT')) AS ok,
    CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE 2 END AS size FROM orders""")
def d15_choices(spark, sf):
    k = F.col("o_orderkey") % 4
    text = col.choice_list(F.when(k == 0, "").when(k == 1, F.concat_ws(",", *["o_orderstatus"] * 3)).otherwise(F.concat_ws(",", "o_orderstatus", "o_orderpriority")))
    return table(spark, sf, "orders").select("o_orderkey", col.all_in(text, ["F", "O", "1-URGENT"]).alias("ok"), F.size(text).alias("size"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS keys FROM events")
def d16_json_parse(spark, sf):
    m = F.from_json("props", "map<string,bigint>")
    return table(spark, sf, "events").select("event_id", m["k"].alias("k"), F.size(m).cast("long").alias("keys"))


@query("""SELECT event_id, [event_type, CAST(user_id AS VARCHAR), 'é"'] = [event_type, CAST(user_id AS VARCHAR), 'é"'] AS listed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 3 END AS n,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS user_id, event_type AS first, CASE WHEN event_id % 3 = 1 THEN NULL ELSE 'k,u' END AS keys FROM events""")
def d16_json_values(spark, sf):
    """Lists, objects in order and tuples out of texts; texts of another kind give null."""
    rows = table(spark, sf, "events")
    k = F.col("event_id") % 3
    made = F.to_json(F.array("event_type", F.col("user_id").cast("string"), F.lit('é"')))
    listed = col.json_list(F.when(k == 0, F.col("props")).otherwise(made))
    pair = F.concat(F.lit('("'), "event_type", F.lit('", '), F.when(k == 0, "x").otherwise(F.col("user_id").cast("string")), F.lit(")"))
    values = col.json_dict(F.when(k == 1, made).otherwise(F.concat(F.lit('{"k": 1, "u": '), F.col("user_id").cast("string"), F.lit("}"))), "long")
    pair = col.json_tuple(pair, "string", "long")
    return rows.select("event_id", F.coalesce(listed == F.array("event_type", F.col("user_id").cast("string"), F.lit('é"')), F.lit(True)).alias("listed"), F.when(listed.isNotNull(), F.size(listed)).cast("int").alias("n"), pair["_2"].alias("user_id"), F.coalesce(pair["_1"], "event_type").alias("first"), F.array_join(F.map_keys(values), ",").alias("keys"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN NOT l_quantity < 40 AND NOT l_tax < 0.07 THEN 'quantity,tax' WHEN NOT l_quantity < 40 THEN 'quantity' ELSE 'tax' END AS errors
    FROM lineitem WHERE NOT (l_quantity < 40 AND l_tax < 0.07)""")
def d17_validate(spark, sf):
    _, bad = col.split_valid(table(spark, sf, "lineitem"), {"quantity": F.col("l_quantity") < 40, "tax": F.col("l_tax") < 0.07})
    return bad.select("l_orderkey", "l_linenumber", F.array_join("errors", ",").alias("errors"))


@query("""SELECT p_partkey, regexp_replace('Load_' || substr(p_brand, 1, 16) || '_' || substr(p_type, 1, 16) || '_' ||
    substr(md5('{"brand":"' || p_brand || '","kind":"' || p_type || '"}'), 1, 10), '[^A-Za-z0-9_]', '_', 'g') AS id FROM part""")
def d18_stable_id(spark, sf):
    return table(spark, sf, "part").select("p_partkey", col.stable_id("Load", {"kind": F.col("p_type"), "brand": F.col("p_brand")}).alias("id"))


@query("SELECT c_nationkey, count(*) AS n, sum(len(x)) AS total FROM (SELECT c_nationkey, [c_mktsegment, c_name] AS x FROM customer) GROUP BY 1")
def d19_deep_flatten(spark, sf):
    from pyspark.sql import types as T

    nested = F.array(F.array("c_mktsegment"), F.array("c_name"))
    flat = col.deep_flatten(nested, T.ArrayType(T.ArrayType(T.StringType())))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(flat)).alias("total"))


@query("SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS r FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) WHERE r = 1")
def d20_most_common(spark, sf):
    return col.most_common(table(spark, sf, "orders"), "o_orderpriority", "o_custkey")


@query("SELECT a.n_name || 'X' AS name, b.n_name AS candidate, levenshtein(a.n_name || 'X', b.n_name) AS distance FROM nation a, nation b WHERE levenshtein(a.n_name || 'X', b.n_name) <= 5 AND levenshtein(a.n_name || 'X', b.n_name) < length(a.n_name) + 1")
def d21_nearest_names(spark, sf):
    nation = table(spark, sf, "nation")
    return col.nearest_names(nation.select(F.concat("n_name", F.lit("X")).alias("name")), nation.select(F.col("n_name").alias("candidate")))


@query("""WITH n AS (SELECT n_name || repeat('X', n_nationkey % 8) AS name FROM nation), d AS (SELECT a.name, b.n_name AS candidate, levenshtein(a.name, b.n_name) AS distance FROM n a, nation b),
    near AS (SELECT name, string_agg(candidate, ',' ORDER BY distance, candidate) AS candidates FROM d WHERE distance <= 5 AND distance < length(name) GROUP BY 1)
    SELECT n.name, coalesce(near.candidates, (SELECT string_agg(n_name, ',' ORDER BY n_name) FROM nation)) AS candidates FROM n LEFT JOIN near ON near.name = n.name""")
def d21_suggestions(spark, sf):
    nation = table(spark, sf, "nation")
    names = nation.select(F.concat(F.col("n_name"), F.repeat(F.lit("X"), (F.col("n_nationkey") % 8).cast("int"))).alias("name"))
    return col.suggestions(names, nation.select(F.col("n_name").alias("candidate"))).select("name", F.array_join("candidates", ",").alias("candidates"))


NAMES_SQL = "SELECT DISTINCT p_name || ' ' || p_brand AS candidate FROM part"


@query(f"""WITH k AS ({NAMES_SQL}), n AS (SELECT DISTINCT replace(candidate, 'r', 'rr') AS name FROM k)
    SELECT name, candidate, levenshtein(name, candidate) AS distance FROM n JOIN k ON abs(length(name) - length(candidate)) <= 5 WHERE levenshtein(name, candidate) <= 5""")
def d21_near_parts(spark, sf):
    """Misspelt names and brands of parts against a register of them."""
    known = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("candidate"))
    return col.nearest_names(known.select(F.replace("candidate", F.lit("r"), F.lit("rr")).alias("name")), known)


@query("SELECT event_id, 'env:test,k:' || json_extract_string(props, '$.k') AS tags FROM events")
def d23_tags(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(col.tags(F.from_json("props", "map<string,string>"), ["env:test"]), ",").alias("tags"))


@query("SELECT p_partkey, p_type || '(brand=' || p_brand || ', size=' || p_size || ')' AS name, 'env:test,brand:' || p_brand || ',size:' || p_size AS tags FROM part")
def d22_display_names(spark, sf):
    m = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", col.display_name(F.col("p_type"), m).alias("name"), F.array_join(col.tags(m, ["env:test"]), ",").alias("tags"))


# ---- map, combine, reduce ----------------------------------------------------------------------------------------


@query("SELECT unnest(['type ' || event_type, 'user ' || user_id]) AS key, value FROM events")
def e1_map_records(spark, sf):
    key = lambda name, c: F.struct(F.concat(F.lit(f"{name} "), F.col(c).cast("string")).alias("key"), F.col("value"))
    return jobs.map_records(table(spark, sf, "events"), F.array(key("type", "event_type"), key("user", "user_id"))).select("key", "value")


@query("SELECT event_type AS key, max(value) AS most, count(*) AS n FROM events GROUP BY 1")
def e3_combine(spark, sf):
    pairs = jobs.map_records(table(spark, sf, "events"), F.array(F.struct(F.col("event_type").alias("key"), F.col("value"))))
    return jobs.reduce_by_key(pairs, F.max("value").alias("most"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def e2_reduce(spark, sf):
    pairs = jobs.map_records(table(spark, sf, "events"), F.array(F.struct(F.col("event_type").alias("key"), F.col("value"))))
    return jobs.reduce_by_key(pairs, F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id AS key, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1")
def e2_reduce_groups(spark, sf):
    import pyarrow as pa
    import pyarrow.compute as pc

    def kinds(group: pa.Table) -> pa.Table:
        return pa.table({"key": group["key"].slice(0, 1), "kinds": pa.array([pc.count_distinct(group["value"]).as_py()], pa.int64())})

    # Only distinct values count, so that a key's group holds each once, whatever its number of events.
    pairs = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value")).distinct()
    return jobs.reduce_groups(pairs, kinds, "key long, kinds long")


@query("""SELECT user_id AS key, count(*) AS gaps, round(max(gap), 4) AS longest, CAST(max(run) AS BIGINT) AS run FROM (SELECT *, count(*) OVER (PARTITION BY user_id, island) AS run
    FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT user_id, ts, event_id, value - lag(value) OVER w AS gap,
      CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))) GROUP BY 1""")
def e2_reduce_sorted(spark, sf):
    """Of each user's events in order: how many, the greatest rise of the value, and the longest run of one type."""
    import pyarrow as pa

    def reducer(key, group):
        n, longest, run, best, value, kind = 0, None, 0, 0, None, None
        for batch in group:
            for v, k in zip(batch["value"].to_pylist(), batch["event_type"].to_pylist(), strict=True):
                if value is not None and v is not None:
                    longest = v - value if longest is None else max(longest, v - value)
                run = run + 1 if n and k == kind else 1
                n, best, value, kind = n + 1, max(best, run), v, k
        row = {"key": key, "gaps": n, "longest": longest, "run": best}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("key", pa.int64()), ("gaps", pa.int64()), ("longest", pa.float64()), ("run", pa.int64())]))

    rows = table(spark, sf, "events").withColumnRenamed("user_id", "key").select("key", "ts", "event_id", "value", "event_type")
    out = jobs.reduce_sorted(rows, reducer, "key long, gaps long, longest double, run long", "ts", "event_id")
    return out.withColumn("longest", F.round("longest", 4))


@query("""SELECT conv_id, unnest(CASE WHEN turn = first THEN [turn] ELSE [turn, before] END) AS turn, unnest(CASE WHEN turn = first THEN ['opens'] ELSE ['answers', 'is answered'] END) AS record
    FROM (SELECT conv_id, turn, min(turn) OVER (PARTITION BY conv_id) AS first, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)""")
def e1_map_table(spark, sf):
    """Records that hang on the row before: a table function by conversation, in the order of its turns."""
    from pyspark.sql import types as T
    from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

    class Turns:
        def __init__(self):
            self.before = None

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            kept = [T.StructField(n, rows.dataType[n].dataType) for n in ("conv_id", "turn")]
            return AnalyzeResult(schema=T.StructType([*kept, T.StructField("record", T.StringType())]))

        def eval(self, row):
            if self.before is None:
                yield row["conv_id"], row["turn"], "opens"
            else:
                yield row["conv_id"], row["turn"], "answers"
                yield row["conv_id"], self.before, "is answered"
            self.before = row["turn"]

    return jobs.map_records_udtf(table(spark, sf, "conversations").select("conv_id", "turn"), Turns, ["conv_id"], ["turn"])


@query("SELECT sum(length(text)) AS points, count(*) AS rows FROM conversations")
def e4_final_hooks(spark, sf):
    import pyarrow as pa
    import pyarrow.compute as pc

    def count(df: DataFrame) -> DataFrame:
        state = {"points": 0, "rows": 0}

        def mapper(batch: pa.RecordBatch):
            state["points"] += pc.sum(pc.utf8_length(batch["text"])).as_py() or 0
            state["rows"] += batch.num_rows
            return ()

        return jobs.map_with_final(df, mapper, lambda: [pa.RecordBatch.from_pylist([state])], "points long, rows long")

    return count(table(spark, sf, "conversations").select("text")).agg(F.sum("points").alias("points"), F.sum("rows").alias("rows"))


@query("SELECT doc_id, split_part(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g')), ' ', 1) AS first FROM documents WHERE text IS NOT NULL")
def e5_map_only(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.coalesce(F.get(jobs.words(F.col("text")), 0), F.lit("")).alias("first"))


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def e6_side_input(spark, sf):
    side = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "customer").join(side, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("SELECT 'lines' AS \"group\", unnest(['returned', 'late']) AS name, unnest([count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_shipdate > TIMESTAMP '2000-01-01')]) AS n FROM lineitem")
def e7_counters(spark, sf):
    return jobs.counters(table(spark, sf, "lineitem"), "lines", returned=F.col("l_returnflag") == "R", late=F.col("l_shipdate") > F.lit("2000-01-01").cast("timestamp_ntz"))


@query("SELECT 'orders' AS \"group\", unnest(['written', 'open', 'dear']) AS name, unnest([count(*), count(*) FILTER (WHERE o_orderstatus = 'O'), count(*) FILTER (WHERE o_totalprice > 100000)]) AS n FROM orders")
def e7_counters_of_write(spark, sf):
    """Counters of a job that writes its rows, taken as they are written."""
    rows, told = jobs.observed(table(spark, sf, "orders"), "orders", written=F.lit(True), open=F.col("o_orderstatus") == "O", dear=F.col("o_totalprice") > 100_000)
    rows.write.parquet(scratch_path(spark, "e7"))
    return told()


@query("SELECT event_id, user_id FROM events")
def e9_group_and_sort(spark, sf):
    return jobs.grouped_and_sorted(table(spark, sf, "events").select("event_id", "user_id"), "user_id")


# ---- run history -------------------------------------------------------------------------------------------------

PARAMS = "(SELECT p_partkey AS task_id, 'brand' AS name, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS VARCHAR) FROM part)"


@query("SELECT p_partkey AS task_id, p_name FROM part WHERE p_size = 7 AND p_brand = (SELECT min(p_brand) FROM part WHERE p_size = 7)")
def g1_with_parameters(spark, sf):
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "task_id")
    brand = part.filter("p_size = 7").agg(F.coalesce(F.min("p_brand"), F.lit(""))).scalar()
    params = part.select("task_id", F.inline(F.array(F.struct(F.lit("brand").alias("name"), F.col("p_brand").alias("value")), F.struct(F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value")))))
    return runs.with_parameters(part, params, {"size": "7", "brand": brand}).select("task_id", "p_name")


@query("""SELECT p_partkey AS task_id, p_name, max(l_shipdate) AS last_ts FROM part LEFT JOIN lineitem ON l_partkey = p_partkey
    WHERE p_type = 'PROMO' AND p_size IN (7) GROUP BY 1, 2""")
def g1_find_runs(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("task_id"), F.col("p_type").alias("name"), "p_name", "p_size")
    params = part.select("task_id", F.lit("size").alias("name"), F.col("p_size").cast("string").alias("value"))
    happened = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("task_id"), F.col("l_shipdate").alias("ts"))
    return runs.find_runs(part, params, happened, "PROMO", {"size": "7"}).select("task_id", "p_name", "last_ts")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def g3_latest_by_stable_id(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return runs.latest_by_stable_id(rows, "user_id", "event_id")


@query(f"SELECT event_id, run, status, ts FROM {EV} WHERE run IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def g3_events_of(spark, sf):
    ids = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("run"))
    return runs.events_of(events(spark, sf), ids).select("event_id", "run", "status", "ts")


NOW = "TIMESTAMP '2024-01-20 12:00:00'"


def now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")


@query(f"SELECT run, max(ts) AS last_ts FROM {EV} WHERE ts >= {NOW} - INTERVAL 24 HOUR GROUP BY 1")
def g2_recent(spark, sf):
    return runs.recent(events(spark, sf), now())


@query(f"SELECT run, arg_max(status, struct_pack(a := ts, b := event_id)) AS status, max(ts) AS ts FROM {EV} GROUP BY 1")
def g4_current_status(spark, sf):
    return runs.current_status(events(spark, sf))


@query(f"SELECT run, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'FAILED') AS failed, count(*) FILTER (WHERE status = 'DISABLED') AS disabled, count(*) FILTER (WHERE status = 'DONE') AS done FROM {EV} GROUP BY 1")
def g5_status_counts(spark, sf):
    return runs.status_counts(events(spark, sf), "run")


@query(f"""SELECT event_id, run, date_diff('microsecond', started, ts) // 1000000 AS seconds FROM (SELECT *, last_value(CASE WHEN status = 'RUNNING' THEN ts END IGNORE NULLS)
    OVER (PARTITION BY run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS started FROM {EV}) WHERE status IN ('DONE', 'FAILED')""")
def g6_execution_time(spark, sf):
    return runs.execution_time(events(spark, sf)).select("event_id", "run", "seconds")


FAILED = f"(SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM {EV} WHERE status = 'FAILED')"
TRAIL = "count(*) OVER (PARTITION BY run ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, run, {TRAIL} AS failures FROM {FAILED}")
def g7_trailing_failures(spark, sf):
    return runs.trailing_failures(events(spark, sf), seconds=86400).select("event_id", "run", "failures")


@query(f"SELECT event_id, failures, failures >= 3 OR since >= 864000 AS disables FROM (SELECT event_id, {TRAIL} AS failures, date_diff('microsecond', min(ts) OVER (PARTITION BY run), ts) // 1000000 AS since FROM {FAILED})")
def g8_disable_rule(spark, sf):
    return runs.disable_rule(events(spark, sf), seconds=86400, hard_timeout=864000).select("event_id", "failures", "disables")


#: Events one by one: s holds a run's failures of ten days, its first failure and since when it is disabled.
CHANGES = f"""WITH RECURSIVE o AS (SELECT run, event_id, ts, status, row_number() OVER (PARTITION BY run ORDER BY ts, event_id) AS n FROM {EV}),
    s AS (SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST([] AS TIMESTAMP[]) AS failed, CAST(NULL AS TIMESTAMP) AS first, CAST(NULL AS TIMESTAMP) AS since, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS TIMESTAMP) AS enabled_at, CAST(NULL AS TIMESTAMP) AS disabled_at FROM o
      UNION ALL
      SELECT run, n, failed, first, CASE WHEN disables THEN ts ELSE since END, event_id, enabled_at, CASE WHEN disables THEN ts END
      FROM (SELECT *, counts AND (len(failed) >= 2 OR ts - first >= INTERVAL 20 DAY) AS disables
        FROM (SELECT run, n, event_id, ts, enabled_at, since, counts, CASE WHEN counts THEN coalesce(first, ts) ELSE first END AS first,
            CASE WHEN counts THEN list_filter(list_append(failed, ts), lambda x: x >= ts - INTERVAL 10 DAY) ELSE failed END AS failed
          FROM (SELECT *, status = 'FAILED' AND since IS NULL AS counts
            FROM (SELECT run, n, event_id, ts, status, CASE WHEN enables THEN least(ts, since + INTERVAL 5 DAY) END AS enabled_at, CASE WHEN enables THEN CAST([] AS TIMESTAMP[]) ELSE failed END AS failed,
                CASE WHEN enables THEN NULL ELSE first END AS first, CASE WHEN enables THEN NULL ELSE since END AS since
              FROM (SELECT o.run, o.n, o.event_id, o.ts, o.status, failed, first, since, since IS NOT NULL AND (o.ts >= since + INTERVAL 5 DAY OR o.status = 'DONE') AS enables
                FROM s JOIN o ON o.run = s.run AND o.n = s.n + 1))))))
    SELECT run, event_id, enabled_at AS ts, 'ENABLED' AS change FROM s WHERE enabled_at IS NOT NULL UNION ALL SELECT run, event_id, disabled_at, 'DISABLED' FROM s WHERE disabled_at IS NOT NULL"""


@query(CHANGES)
def g8_disable_changes(spark, sf):
    return runs.disable_changes(events(spark, sf), seconds=10 * 86400, retry_count=2, hard_timeout=20 * 86400, persist=5 * 86400)


@query(f"SELECT owner, family, count(*) FILTER (WHERE status = 'FAILED') AS failures, count(*) FILTER (WHERE status = 'DISABLED') AS disables FROM (SELECT unnest(['a' || run % 7, 'b' || run % 3]) AS owner, json_extract_string(props, '$.k') AS family, status FROM {EV}) GROUP BY 1, 2")
def g9_owner_digest(spark, sf):
    owners = F.array(F.concat(F.lit("a"), F.col("run") % 7), F.concat(F.lit("b"), F.col("run") % 3))
    rows = events(spark, sf).withColumn("owners", owners).withColumn("family", F.get_json_object("props", "$.k"))
    return runs.owner_digest(rows, "owners", "family")


@query(f"SELECT run, props, rank FROM (SELECT run, props, row_number() OVER (PARTITION BY run ORDER BY max(ts) DESC, props) AS rank FROM {EV} GROUP BY 1, 2) WHERE rank <= 3")
def g10_last_messages(spark, sf):
    return runs.last_messages(events(spark, sf), "run", "props", 3).select("run", "props", "rank")


@query(f"""SELECT props AS tail, string_agg(DISTINCT CAST(run AS VARCHAR), ',' ORDER BY CAST(run AS VARCHAR)) AS names, count(*) FILTER (WHERE status = 'FAILED') AS failures, count(*) FILTER (WHERE status = 'DISABLED') AS disables, min(CAST(run AS VARCHAR)) AS first_name FROM {EV} GROUP BY 1""")
def g11_digest_groups(spark, sf):
    rows = events(spark, sf).select("props", F.col("run").cast("string").alias("run"), "status")
    one = rows.groupBy("props", "run").agg(F.count_if(F.col("status") == "FAILED").alias("failures"), F.count_if(F.col("status") == "DISABLED").alias("disables"))
    return runs.digest_groups(one, "props", "run")


OUT = f"""(SELECT run, d AND p AS completed, d AND NOT p AS already_done, f AS ever_failed, f AND NOT (d AND p) AS failed, u AS scheduling_error, p AND NOT d AND NOT f AS still_pending
    FROM (SELECT run, bool_or(status = 'DONE') AS d, bool_or(status = 'PENDING') AS p, bool_or(status = 'FAILED') AS f, bool_or(status = 'UNKNOWN') AS u FROM {EV} GROUP BY 1))"""


@query(f"SELECT * FROM {OUT}")
def g12_outcomes(spark, sf):
    return runs.outcomes(events(spark, sf))


@query(f"""SELECT g, count(*) FILTER (WHERE ever_failed) AS ever_failed, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE scheduling_error) AS scheduling_error, count(*) FILTER (WHERE still_pending) AS still_pending,
    CASE WHEN count(*) FILTER (WHERE ever_failed) > 0 AND count(*) FILTER (WHERE failed) = 0 AND count(*) FILTER (WHERE scheduling_error) = 0 THEN 'success with retry'
      WHEN count(*) FILTER (WHERE failed) > 0 AND count(*) FILTER (WHERE scheduling_error) > 0 THEN 'failed and scheduling failed' WHEN count(*) FILTER (WHERE failed) > 0 THEN 'failed'
      WHEN count(*) FILTER (WHERE scheduling_error) > 0 THEN 'scheduling failed' WHEN count(*) FILTER (WHERE still_pending) > 0 THEN 'not run' ELSE 'success' END AS verdict
    FROM (SELECT *, run % 50 AS g FROM {OUT}) GROUP BY 1""")
def g13_verdict(spark, sf):
    return runs.verdict(runs.outcomes(events(spark, sf)).withColumn("g", F.col("run") % 50), "g")


@query(f"SELECT status, family, count(*) AS n FROM (SELECT status, run % 10 AS family FROM {EV}) GROUP BY 1, 2")
def g14_outcome_table(spark, sf):
    return events(spark, sf).groupBy("status", (F.col("run") % 10).alias("family")).agg(F.count(F.lit(1)).alias("n"))


# Nodes are turns of conversations: conv_id * 1000 + turn; a turn depends on the one before it.
NODES = """(SELECT conv_id * 1000 + turn AS id, CASE (conv_id + turn * turn) % 7 WHEN 0 THEN 'DONE' WHEN 1 THEN 'RUNNING' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'DISABLED' WHEN 4 THEN 'MISSING' ELSE 'PENDING' END AS status FROM conversations)"""
EDGES = "(SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn - 1 AS dst FROM conversations WHERE turn > (SELECT min(turn) FROM conversations))"


def nodes(spark, sf):
    k = (F.col("conv_id") + F.col("turn") * F.col("turn")) % 7
    status = F.when(k == 0, "DONE").when(k == 1, "RUNNING").when(k == 2, "FAILED").when(k == 3, "DISABLED").when(k == 4, "MISSING").otherwise("PENDING")
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), status.alias("status"))


def edges(spark, sf):
    rows = table(spark, sf, "conversations")
    first = rows.agg(F.min("turn").alias("__first"))
    late = rows.join(F.broadcast(first)).filter(F.col("turn") > F.col("__first"))  # one row
    return late.select((F.col("conv_id") * 1000 + F.col("turn")).alias("src"), (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("dst"))


CONE = f"""cone AS (SELECT id AS root, id AS node, 0 AS depth FROM {NODES} UNION ALL SELECT c.root, e.dst, c.depth + 1 FROM cone c JOIN {EDGES} e ON e.src = c.node)"""


@query(f"""WITH RECURSIVE {CONE} SELECT n.id, bool_or(coalesce(s.status = 'FAILED', false)) AS upstream_failure, bool_or(coalesce(s.status = 'MISSING', false)) AS upstream_missing, bool_or(coalesce(s.status = 'RUNNING', false)) AS run_by_other,
    bool_or(c.node IS NOT NULL AND s.status IS NULL) AS scheduling_error, NOT (bool_or(coalesce(s.status IN ('FAILED', 'RUNNING', 'MISSING'), false)) OR bool_or(c.node IS NOT NULL AND s.status IS NULL)) AS not_run
    FROM {NODES} n LEFT JOIN (SELECT * FROM cone WHERE depth > 0) c ON c.root = n.id LEFT JOIN {NODES} s ON s.id = c.node WHERE n.status = 'PENDING' GROUP BY n.id""")
def g15_blocked_because(spark, sf):
    return lineage.blocked_because(edges(spark, sf), nodes(spark, sf))


@query(f"""WITH RECURSIVE cone AS (SELECT id AS root, id AS node, 0 AS depth FROM {NODES} WHERE status <> 'DONE'
    UNION ALL SELECT c.root, e.dst, c.depth + 1 FROM cone c JOIN {EDGES} e ON e.src = c.node LEFT JOIN {NODES} s ON s.id = e.dst WHERE coalesce(s.status, '') <> 'DONE')
    SELECT n.id, coalesce(max(CASE s.status WHEN 'RUNNING' THEN 1 WHEN 'MISSING' THEN 2 WHEN 'FAILED' THEN 3 WHEN 'DISABLED' THEN 4 ELSE 0 END), 0) AS severity
    FROM {NODES} n LEFT JOIN (SELECT * FROM cone WHERE depth > 0) c ON c.root = n.id LEFT JOIN {NODES} s ON s.id = c.node GROUP BY 1""")
def g16_upstream_severity(spark, sf):
    return lineage.upstream_severity(edges(spark, sf), nodes(spark, sf))


@query(f"WITH RECURSIVE {CONE} SELECT c.root, c.node, c.depth, coalesce(s.status, 'UNKNOWN') AS status FROM cone c LEFT JOIN {NODES} s ON s.id = c.node")
def g17_closure(spark, sf):
    return lineage.with_status(lineage.closure(edges(spark, sf), nodes(spark, sf)), nodes(spark, sf)).select("root", "node", "depth", "status")


@query(f"""WITH RECURSIVE {CONE}, goals AS (SELECT id FROM {NODES} WHERE status = 'FAILED'), up AS (SELECT id AS node FROM goals UNION SELECT e.src FROM up JOIN {EDGES} e ON e.dst = up.node)
    SELECT DISTINCT node FROM cone WHERE root IN (SELECT id FROM {NODES} WHERE status = 'PENDING') AND node IN (SELECT node FROM up)""")
def g18_on_paths(spark, sf):
    n = nodes(spark, sf)
    return lineage.on_paths(edges(spark, sf), n.filter("status = 'PENDING'"), n.filter("status = 'FAILED'"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), '1')")
def g19_search(spark, sf):
    return runs.search(table(spark, sf, "part"), "p_name", ["A", "1"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'r') AND contains(lower(p_name), 'wid')")
def g19_search_terms(spark, sf):
    return runs.search(table(spark, sf, "part"), "p_name", ["R", "Wid"]).select("p_partkey", "p_name")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '7') GROUP BY 1")
def g20_search_by_status(spark, sf):
    return runs.search_by_status(table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status")), "id", "7")


@query(f"SELECT e.src, coalesce(s.status, 'UNKNOWN') AS dep_status, count(*) AS n FROM {EDGES} e LEFT JOIN {NODES} s ON s.id = e.dst WHERE CAST(e.src AS VARCHAR) LIKE '1%' GROUP BY 1, 2")
def g21_dependency_status(spark, sf):
    return runs.dependency_status(nodes(spark, sf), edges(spark, sf), "1")


@query(f"SELECT id, status FROM {NODES} n WHERE status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM {EDGES} e LEFT JOIN {NODES} s ON s.id = e.dst WHERE e.src = n.id AND coalesce(s.status, '') <> 'DONE')")
def g22_ready(spark, sf):
    return runs.ready(nodes(spark, sf), edges(spark, sf)).select("id", "status")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderdate, o_orderkey) AS rank FROM orders")
def g23_priority_order(spark, sf):
    return runs.priority_order(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey").select("o_orderkey", "rank")


@query("""SELECT l_suppkey AS resource, round(sum(l_quantity), 4) AS used, count(DISTINCT l_orderkey) AS consumers, coalesce(max(s_acctbal), 1.0) AS total
    FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) ON s_suppkey = l_suppkey WHERE l_linestatus = 'O' GROUP BY 1""")
def g24_resource_usage(spark, sf):
    running = table(spark, sf, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_suppkey").alias("resource"), F.col("l_quantity").alias("amount"), F.col("l_orderkey").alias("consumer"))
    totals = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("resource"), F.col("s_acctbal").alias("total"))
    return runs.resource_usage(running, totals).select("resource", F.round("used", 4).alias("used"), "consumers", "total")


@query(f"""SELECT worker, count(*) FILTER (WHERE status = 'RUNNING') AS running, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'PENDING' AND alone) AS unique_pending
    FROM (SELECT status, run % 5 = run % 7 AS alone, unnest(list_distinct([run % 5, run % 7])) AS worker FROM {EV}) GROUP BY 1""")
def g25_worker_table(spark, sf):
    rows = events(spark, sf).withColumn("workers", F.array_distinct(F.array(F.col("run") % 5, F.col("run") % 7)))
    return runs.worker_table(rows, "workers")


@query("SELECT o_custkey, o_orderstatus, batch, max(o_orderdate) AS o_orderdate, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1) // 4 AS batch FROM orders) GROUP BY 1, 2, 3")
def g26_batches(spark, sf):
    return runs.batches(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "o_orderdate", "o_orderkey", 4)


@query(f"SELECT event_id, gap FROM (SELECT event_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY run ORDER BY ts, event_id), ts) // 1000000 AS gap FROM {EV}) WHERE gap > 86400")
def g27_silences(spark, sf):
    return runs.silences(events(spark, sf), "run", 86400).select("event_id", "gap")


@query(f"""WITH cur AS (SELECT run, arg_max(status, struct_pack(a := ts, b := event_id)) AS status FROM {EV} GROUP BY 1),
    gone AS (SELECT run FROM {EV} WHERE ts <= {NOW} GROUP BY 1 HAVING date_diff('microsecond', max(ts), {NOW}) // 1000000 > 172800)
    SELECT run, CASE WHEN status = 'RUNNING' AND run IN (SELECT run FROM gone) THEN 'FAILED' ELSE status END AS status FROM cur""")
def g27_fail_silent(spark, sf):
    rows = events(spark, sf)
    return runs.fail_silent(runs.current_status(rows), rows.filter(F.col("ts") <= now()), now(), "run", 172_800).select("run", "status")


# ---- batch twins of the streams ----------------------------------------------------------------------------------


@query(f"""SELECT start, start + INTERVAL 2 HOUR AS "end", run, count(*) AS failures FROM (SELECT run, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS start FROM {EV} WHERE status = 'FAILED') GROUP BY 1, 3""")
def s2_failure_rate(spark, sf):
    rows = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.failure_rate(rows, "run", "2 hours", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(f"""WITH g AS (SELECT run, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY run ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new, event_id FROM {EV}),
    s AS (SELECT run, ts, sum(new) OVER (PARTITION BY run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", run, count(*) AS beats FROM s GROUP BY run, n""")
def s3_heartbeat_sessions(spark, sf):
    rows = events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.heartbeat_sessions(rows, "run", "6 hours")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))
