"""Sinks: dispositions, staged publishing, validation before it, exports and idempotent loads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.jobs import toplist
from ..operators.markers import last_value_per_key
from .readers import _path, exists


def _take_place(spark: SparkSession, staged: str, path: str, overwrite: bool) -> None:
    """Rename a staged folder to its destination. What is overwritten is renamed aside first, and deleted at last."""
    fs, stage = _path(spark, staged)
    target, aside = _path(spark, path)[1], _path(spark, f"{path.rstrip('/')}-old-{uuid.uuid4().hex}")[1]
    if fs.exists(target):
        if not overwrite:
            raise FileExistsError(path)
        if not fs.rename(target, aside):
            raise OSError(f"could not move {path} aside")
    if not fs.rename(stage, target):
        if fs.exists(aside):
            fs.rename(aside, target)
        raise OSError(f"could not publish {path}")
    fs.delete(aside, True)


def publish(df: DataFrame, path: str, form: str = "parquet", overwrite: bool = False, rules: Mapping[str, Column] | None = None, **options) -> None:
    """Write beside the destination and rename once complete; a failure leaves nothing behind.

    With ``rules`` the staged rows are read back and checked first, and any violation is a failure.
    """
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}-tmp-{uuid.uuid4().hex}"
    fs, stage = _path(spark, staged)
    try:
        df.write.options(**options).format(form).save(staged)
        if rules:
            found = {k: v for k, v in violations(spark.read.schema(df.schema).options(**options).format(form).load(staged), rules).first().asDict().items() if v}
            if found:
                raise ValueError(f"rows break rules: {found}")
        _take_place(spark, staged, path, overwrite)
    finally:
        if fs.exists(stage):
            fs.delete(stage, True)


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each rule, in one pass; null breaks it."""
    return df.agg(*(F.count_if(~F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()))


def validate_and_publish(df: DataFrame, path: str, rules: Mapping[str, Column], **options) -> None:
    """Stage, check the staged rows, then rename them into place: they are written once. Any violation cleans up and fails."""
    publish(df, path, rules=rules, **options)


def replace_partitions(new: DataFrame, path: str, *partition: str) -> None:
    """Put new rows in the place of those of the partitions that they have; other partitions aren't touched or read."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def write_disposed(df: DataFrame, path: str, write: str = "EMPTY", create: str = "CREATE_IF_NEEDED") -> None:
    """TRUNCATE replaces, APPEND adds, EMPTY fails if there are rows; CREATE_NEVER fails if nothing is there."""
    spark = df.sparkSession
    there = exists(spark, path)
    if create == "CREATE_NEVER" and not there:
        raise FileNotFoundError(path)
    if write == "EMPTY" and there and not spark.read.parquet(path).isEmpty():
        raise FileExistsError(path)
    df.write.mode({"TRUNCATE": "overwrite", "APPEND": "append", "EMPTY": "append"}[write]).parquet(path)


def copy_table(spark: SparkSession, source: str, path: str, write: str = "EMPTY") -> None:
    write_disposed(spark.read.parquet(source), path, write)


def extract(df: DataFrame, path: str, form: str = "csv", header: bool = True, sep: str = ",", compression: str = "none") -> None:
    writer = df.write.option("compression", compression)
    writer.csv(path, header=header, sep=sep) if form == "csv" else writer.format(form).save(path)


def export_key_values(lines: DataFrame, text: str, order: str, path: str, sep: str = "\t") -> None:
    """The last value of each key of a table of lines as key, separator, value; sorted by key, so that a reader can seek."""
    last = last_value_per_key(lines, text, order, sep)
    last.orderBy("key").select(F.concat("key", F.lit(sep), "value").alias("value")).write.mode("overwrite").text(path)


def unload(df: DataFrame, path: str) -> None:
    """Bar-separated, all fields quoted, gzip, replacing what is there."""
    df.write.mode("overwrite").csv(path, sep="|", quoteAll=True, compression="gzip")


def idempotent_load(df: DataFrame, table: str, markers: str, update_id: str) -> bool:
    """Load ``df`` into the directory table unless its update is marked; whether it was loaded.

    Rows go to a directory named by the update and count once the marker is there: an attempt that broke off is
    overwritten by the next, and readers (``read_marked``) don't see it.
    """
    spark = df.sparkSession
    if exists(spark, markers) and not spark.read.parquet(markers).filter(F.col("update_id") == update_id).isEmpty():
        return False
    df.write.mode("overwrite").parquet(f"{table}/update_id={update_id}")
    mark_update(spark, markers, update_id, table)
    return True


def mark_update(spark: SparkSession, markers: str, update_id: str, table: str) -> None:
    row = spark.range(1).select(F.lit(update_id).alias("update_id"), F.lit(table).alias("target_table"), F.current_timestamp().alias("inserted"))
    row.write.mode("append").parquet(markers)


def read_marked(spark: SparkSession, table: str, markers: str) -> DataFrame:
    return spark.read.parquet(table).join(spark.read.parquet(markers).select("update_id").distinct(), "update_id", "left_semi")


def jdbc_load(df: DataFrame, url: str, table: str, driver: str, truncate: bool = False, batch: int = 5000) -> None:
    """Rows in batches into a database table, emptied first with ``truncate``."""
    writer = df.write.format("jdbc").option("url", url).option("dbtable", table).option("driver", driver).option("batchsize", batch)
    writer.option("truncate", truncate).mode("overwrite" if truncate else "append").save()


def jdbc_run(spark: SparkSession, url: str, *statements: str) -> None:
    """Run statements in one transaction of a database; all or none take effect."""
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def jdbc_table_exists(spark: SparkSession, url: str, table: str) -> bool:
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        found = connection.getMetaData().getTables(None, None, table, None)
        return found.next()
    finally:
        connection.close()


def jdbc_idempotent_load(
    df: DataFrame, url: str, table: str, driver: str, update_id: str, columns: list | None = None, markers: str = "TABLE_UPDATES", before: tuple[str, ...] = (), after: tuple[str, ...] = (),
    metadata: tuple[str, ...] = (), batch: int = 5000,
) -> bool:
    """Load ``df`` into a database table unless its update is marked; whether it was loaded.

    ``columns`` are (name, type) pairs, of which a missing table is made; names alone are an error then. Rows go to a
    table of their own in parallel batches. Then one transaction runs the statements ``before``, moves the rows,
    and runs ``after``, ``metadata`` and the mark, so that a load that broke off leaves neither rows nor a mark. Names
    are taken as they are, as a database in upper case has them.
    """
    spark = df.sparkSession
    quoted = update_id.replace("'", "''")
    if not jdbc_table_exists(spark, url, markers):
        jdbc_run(spark, url, f"CREATE TABLE {markers} (UPDATE_ID VARCHAR(255) PRIMARY KEY, TARGET_TABLE VARCHAR(255), INSERTED TIMESTAMP)")
    marked = spark.read.format("jdbc").option("url", url).option("driver", driver).option("query", f"SELECT UPDATE_ID FROM {markers} WHERE UPDATE_ID = '{quoted}'").load()
    if not marked.isEmpty():
        return False
    names = [c if isinstance(c, str) else c[0] for c in columns or df.columns]
    if not jdbc_table_exists(spark, url, table):
        if columns is None or any(isinstance(c, str) for c in columns):
            raise ValueError(f"{table} isn't there, and its columns have no types")
        jdbc_run(spark, url, f"CREATE TABLE {table} ({', '.join(f'{n} {t}' for n, t in columns)})")
    staged = f"STAGE_{uuid.uuid4().hex[:12].upper()}"
    jdbc_run(spark, url, f"CREATE TABLE {staged} AS SELECT {', '.join(names)} FROM {table} WITH NO DATA")
    try:
        df.select(*names).write.format("jdbc").option("url", url).option("dbtable", staged).option("driver", driver).option("batchsize", batch).mode("append").save()
        move = f"INSERT INTO {table} ({', '.join(names)}) SELECT {', '.join(names)} FROM {staged}"
        mark = f"INSERT INTO {markers} VALUES ('{quoted}', '{table}', CURRENT_TIMESTAMP)"
        jdbc_run(spark, url, *before, move, *after, *metadata, mark)
    finally:
        jdbc_run(spark, url, f"DROP TABLE {staged}")
    return True


def toplist_to_database(counts: DataFrame, key: str, n: int, date_from: str, date_to: str, url: str, table: str, driver: str, columns: list) -> bool:
    """The ``n`` keys with highest counts of an interval into a database table, once for each interval."""
    top = toplist(counts, key, n, date_from, date_to)
    names = [c[0] for c in columns]
    return jdbc_idempotent_load(top.toDF(*names), url, table, driver, f"{table}-{date_from}-{date_to}", columns)


def shaped_documents(docs: DataFrame, index: str, doc_type: str, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Documents with _index and _type where they lack them, and the types that a mapping gives its fields.

    A value that isn't of its field's type becomes null; fields that the mapping doesn't have stay as they are.
    """
    named = docs
    for name, value in (("_index", index), ("_type", doc_type)):
        named = named.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in docs.columns else F.lit(value))
    kinds = mapping or {}
    return named.select(*(F.col(f"`{c}`").try_cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in named.columns))


def load_documents(docs: DataFrame, folder: str, markers: str, update_id: str, index: str, doc_type: str, purge: bool = False, chunk: int = 2000, mapping: Mapping[str, str] | None = None) -> bool:
    """JSON documents with _index and _type, files of at most ``chunk`` of them, unless the update is marked.

    Documents are written out of sight and renamed into the folder once they are whole. ``purge`` removes what other
    updates left in the folder, after that: a load that fails leaves them readable. Null fields are left out of a
    document. Whether it was loaded.
    """
    spark = docs.sparkSession
    if exists(spark, markers) and not spark.read.parquet(markers).filter(F.col("update_id") == update_id).isEmpty():
        return False
    staged = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    fs, stage = _path(spark, staged)
    try:
        shaped_documents(docs, index, doc_type, mapping).write.option("maxRecordsPerFile", chunk).json(staged)
        _take_place(spark, staged, f"{folder.rstrip('/')}/update_id={update_id}", overwrite=True)
    finally:
        if fs.exists(stage):
            fs.delete(stage, True)
    for status in fs.listStatus(_path(spark, folder)[1]) if purge else ():
        name = status.getPath().getName()
        if not name.startswith("_") and name != f"update_id={update_id}":
            fs.delete(status.getPath(), True)
    mark_update(spark, markers, update_id, folder)
    return True


def add_metadata(df: DataFrame, columns: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Add columns that are absent, each with a type and a fill."""
    for name, (kind, fill) in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, fill.cast(kind))
    return df


def _of_texts(f: Callable[[str | None], str | None]):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return run


def query_to_table(spark: SparkSession, sql: str, path: str, args: Mapping | None = None, functions: Mapping[str, object] | None = None, write: str = "TRUNCATE", markers: str | None = None, update_id: str | None = None) -> bool:
    """Run a query with named variables and functions of one's own, and store its rows; whether it was run.

    Functions are Spark's user-defined functions, such as of ``pandas_udf``, which get whole batches; or plain ones of one
    text, which are called for each value of a batch. With ``markers`` an update is run and marked once.
    """
    if markers and exists(spark, markers) and not spark.read.parquet(markers).filter(F.col("update_id") == update_id).isEmpty():
        return False
    for name, f in (functions or {}).items():
        spark.udf.register(name, f if hasattr(f, "evalType") else _of_texts(f))
    write_disposed(spark.sql(sql, args=dict(args or {})), path, write)
    if markers:
        mark_update(spark, markers, update_id, path)
    return True
