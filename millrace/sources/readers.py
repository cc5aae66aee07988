"""Sources: text and JSON readers, listings, manifests, and loads with reject limits."""

from __future__ import annotations

import json
import re
import warnings
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_delimited(spark: SparkSession, paths, schema: str, sep: str = "\t", keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines split on a separator of any length: no quotes, no trimming, fields by place. ``keep`` are partition columns
    that the paths tell."""
    fields = T._parse_datatype_string(schema).fields
    parts = F.split("value", "\\Q" + sep + "\\E", -1)
    df = spark.read.option("lineSep", "\n").text(paths)
    return df.select(*(F.get(parts, i).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)), *keep)


def split_fields(text: Column, *names: str) -> list[Column]:
    """Fields of a line split on white space, by place."""
    parts = F.split(F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " ")), " ")
    return [F.get(parts, i).alias(n) for i, n in enumerate(names)]


def read_text(spark: SparkSession, paths, encoding: str = "UTF-8", normalise: bool = True) -> DataFrame:
    """Lines in a charset; with ``normalise`` CR LF and CR end lines too. gzip and bzip2 files are read as such.

    Spark's text source cuts lines in a charset but takes their bytes as UTF-8, so they are decoded here. In charsets of
    two and more bytes a unit a CR alone ends no line.
    """
    reader, wide = spark.read.option("encoding", encoding), encoding.upper().startswith(("UTF-16", "UTF-32"))
    if wide or not normalise:
        reader = reader.option("lineSep", "\n")
    df = reader.text(paths)
    if encoding.upper().replace("-", "") != "UTF8":
        df = df.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    return df.withColumn("value", F.regexp_replace("value", "\r$", "")) if wide and normalise else df


def interval_paths(template: str, start: date, stop: date) -> list[str]:
    """The template, in strftime's terms, for each date from start to before stop."""
    return [(start + timedelta(i)).strftime(template) for i in range((stop - start).days)]


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def flagged(spark: SparkSession, path: str, flag: str = "_SUCCESS") -> bool:
    """Whether a directory is there with its flag file; its path must end in "/"."""
    if not path.endswith("/"):
        raise ValueError("the path of a flagged directory ends in /")
    return exists(spark, path + flag)


def list_files(spark: SparkSession, path, after: str | None = None, before: str | None = None, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """path, modified and size of files with after < modified < before, both open and optional. No content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    for name, value in (("modifiedAfter", after), ("modifiedBefore", before), ("pathGlobFilter", glob)):
        if value is not None:
            reader = reader.option(name, value)
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def dataset_usage(files: DataFrame, dataset: Column) -> DataFrame:
    """Directories, files and bytes per dataset of a listing."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(dataset.alias("dataset")).agg(F.count_distinct(folder).alias("directories"), F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def parts_reached(usage: DataFrame, expected_: int) -> DataFrame:
    """Whether each dataset of ``dataset_usage`` has its expected number of part files."""
    return usage.withColumn("reached", F.col("files") >= expected_)


def read_interval(spark: SparkSession, template: str, start: date, stop: date, form: str = "parquet", **options) -> DataFrame:
    """One table of the paths of all dates from start to before stop; dates that have no path are left out."""
    return spark.read.options(**options).format(form).load([p for p in interval_paths(template, start, stop) if exists(spark, p)])


def partitions_with_files(files: DataFrame, partition: Column, ignore: str | None = None) -> DataFrame:
    """Partitions that hold a file whose name doesn't match the mask."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    kept = files if ignore is None else files.filter(~name.rlike(ignore))
    return kept.select(partition.alias("partition")).distinct()


def date_of_path(path: Column, pattern: str = r"(\d{4}).*?(\d{2}).*?(\d{2}).*?(\d{2})") -> Column:
    """Timestamp of year, month, day and hour (and minute, if the pattern has a fifth group) in a path."""
    group = lambda i: F.regexp_extract(path, pattern, i).try_cast("int")
    minute = group(5) if pattern.count("(") > 4 else F.lit(0)
    return F.when(path.rlike(pattern), F.make_timestamp_ntz(group(1), group(2), group(3), group(4), minute, F.lit(0).cast("decimal(16,6)")))


#: The parts of a layout, what they match, and what stands for those that a layout lacks.
LAYOUT = {"Y": (r"\d{4}", None), "m": (r"\d{2}", "01"), "d": (r"\d{2}", "01"), "H": (r"\d{2}", "00"), "M": (r"\d{2}", "00")}


def layout_pattern(layout: str) -> tuple[str, list[str]]:
    """A layout such as /in/%Y/%m-%d/%H as a pattern with a group for each part, and the parts in order."""
    pieces = re.split(r"%([YmdHM])", layout)
    return "".join(f"({LAYOUT[x][0]})" if i % 2 else re.escape(x) for i, x in enumerate(pieces)), pieces[1::2]


def date_by_layout(path: Column, layout: str) -> Column:
    """Timestamp of the parts of a path in a layout; null where it doesn't match or is no date."""
    pattern, parts = layout_pattern(layout)
    part = {p: F.regexp_extract(path, pattern, i + 1) if p in parts else F.lit(LAYOUT[p][1]) for i, p in [(parts.index(p) if p in parts else 0, p) for p in LAYOUT]}
    text = F.concat(part["Y"], F.lit("-"), part["m"], F.lit("-"), part["d"], F.lit(" "), part["H"], F.lit(":"), part["M"], F.lit(":00"))
    return F.when(path.rlike(pattern), text.try_cast("timestamp_ntz"))


def layout_matches(files: DataFrame, layouts: list[str]) -> DataFrame:
    """(layout, n): how many paths of a listing each layout gives a date for; the first is the one to take."""
    each = F.array(*(F.struct(F.lit(x).alias("layout"), F.lit(i).alias("i"), date_by_layout(F.col("path"), x).isNotNull().cast("long").alias("hit")) for i, x in enumerate(layouts)))
    counted = files.select(F.inline(each)).groupBy("layout").agg(F.sum("hit").alias("n"), F.min("i").alias("i"))
    return counted.orderBy(F.desc("n"), "i").select("layout", "n")


def documents(lines: DataFrame, schema: str, index: str, doc_type: str, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON documents with _index and _type filled in only where they lack them; ``keep`` are columns of the lines that stay."""
    doc = lines.select(*keep, F.from_json(text, f"{schema}, _index string, _type string").alias("d")).select(*keep, "d.*")
    return doc.withColumn("_index", F.coalesce("_index", F.lit(index))).withColumn("_type", F.coalesce("_type", F.lit(doc_type)))


def json_by_paths(lines: DataFrame, paths: dict[str, str | tuple[str, str]], text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """A column for each path of JSON texts, as text or as the type given with it; null where there is none of the kind.

    A text is parsed once, into a variant, whatever the number of paths. Texts that are no JSON have nulls; numbers are
    told by their value, so that 1.0 is "1".
    """
    asked = {n: (p, "string") if isinstance(p, str) else p for n, p in paths.items()}
    parsed = lines.select(*keep, F.try_parse_json(text).alias("__v"))
    return parsed.select(*keep, *(F.try_variant_get("__v", p, kind).alias(n) for n, (p, kind) in asked.items()))


def _filled(kind: T.DataType) -> T.DataType:
    """A type whose unknown parts, those that are null in all texts, are texts."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _filled(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_filled(kind.elementType))
    return T.StringType() if isinstance(kind, T.NullType) else kind


def found_schema(lines: DataFrame, text: str = "value") -> T.StructType:
    """The schema that all JSON objects of a table have in common: every field of any of them, with the type that holds
    all its values. One aggregation, of which one row reaches the driver."""
    row = lines.filter(F.ltrim(text).startswith("{")).agg(F.schema_of_variant_agg(F.try_parse_json(text)).alias("kind")).first()
    kind = re.sub(r"\bOBJECT<", "STRUCT<", row.kind or "")
    if not kind.startswith("STRUCT<"):
        raise ValueError(f"no JSON objects of one kind: {row.kind}")
    return _filled(T._parse_datatype_string(kind))


def found_documents(lines: DataFrame, text: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """JSON objects as columns by the schema that is found in them, nested ones as structs and lists."""
    schema = found_schema(lines, text)
    typed = lines.select(*keep, F.try_variant_get(F.try_parse_json(text), "$", schema.simpleString()).alias("__d"))
    return typed.select(*keep, *(F.col("__d").getField(f.name).alias(f.name) for f in schema.fields))


def _with_heads(spark: SparkSession, path, encoding: str) -> DataFrame:
    """(value, file, at, n, head) of all lines. A file's first lines are in its first split (``at`` 0), where the numbers
    n of lines follow each other from head on."""
    lines = read_text(spark, path, encoding).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    return lines.join(lines.filter("at = 0").groupBy("file").agg(F.min("n").alias("head")), "file")


def _fields(sep: str, quote: str = '"') -> tuple[str, str]:
    """Patterns of a CSV field and of what is quoted."""
    q, s = re.escape(quote), re.escape(sep)
    quoted = f"{q}(?:[^{q}]|{q}{q})*{q}"
    return f"(?:{quoted}|[^{s}{q}]*)", quoted


def load_files(spark: SparkSession, path, form: str, schema: str | None = None, max_bad: int = 0, skip: int = 0, ignore_unknown: bool = False, jagged: bool = False, sep: str = ",", encoding: str = "UTF-8", **options) -> DataFrame:
    """CSV, JSON, Parquet or Avro rows; more than ``max_bad`` rows that don't fit the schema are an error.

    Bad rows within the limit are left out. Rows of CSV may have fewer fields with ``jagged``, and rows of CSV and JSON
    more with ``ignore_unknown``; both are bad else. ``skip`` leading lines of each CSV file are left out. Text files
    are read line by line; with the reader's option multiLine the whole file goes to Spark's reader, which can skip a
    header only and takes unknown fields of JSON. Without a schema the types are inferred. Parquet and Avro have no bad
    rows: a file that doesn't fit is an error.
    """
    reader = spark.read.options(**options)
    if form in ("parquet", "avro"):
        return (reader.schema(schema) if schema else reader).format(form).load(avro_paths(path) if form == "avro" else path)
    whole = str(options.get("multiLine", False)).lower() == "true"
    if schema is None or whole:
        if skip > (form == "csv"):
            raise ValueError("only the header of a CSV file can be skipped without a schema or with multiLine")
        reader = reader.option("encoding", encoding)
        reader = reader.option("header", skip == 1).option("sep", sep) if form == "csv" else reader
        if schema is None:
            return reader.option("inferSchema", True).format(form).load(path)
        rows = reader.schema(f"{schema}, __bad string").option("columnNameOfCorruptRecord", "__bad").option("mode", "PERMISSIVE").format(form).load(path)
        if len(rows.filter("__bad IS NOT NULL").limit(max_bad + 1).collect()) > max_bad:
            raise ValueError(f"more than {max_bad} rows don't fit")
        return rows.filter("__bad IS NULL").drop("__bad")
    kinds = spark.createDataFrame([], schema).schema
    width, value = len(kinds), F.col("value")
    lines = _with_heads(spark, path, encoding).filter((F.col("at") > 0) | (F.col("n") >= F.col("head") + skip)) if skip else read_text(spark, path, encoding)
    lines = lines.filter(F.length(F.trim("value")) > 0)
    known = {k: str(v) for k, v in options.items()} | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    fits = F.lit(True)
    if form == "csv":
        field, quoted = _fields(sep, str(options.get("quote", '"')))
        n = F.regexp_count(F.regexp_replace(value, quoted, ""), F.lit(re.escape(sep))) + 1
        more = F.regexp_extract(value, f"^({field}(?:{re.escape(sep)}{field}){{{width - 1}}})", 1) if ignore_unknown else value
        fewer = F.concat(value, F.repeat(F.lit(sep), F.lit(width) - n)) if jagged else value
        parsed = F.from_csv(F.when(n > width, more).when(n < width, fewer).otherwise(value), f"{schema}, __bad string", known | {"sep": sep})
        fits = ((n <= width) | F.lit(ignore_unknown)) & ((n >= width) | F.lit(jagged))
    else:
        parsed = F.from_json(value, f"{schema}, __bad string", known)
        if not ignore_unknown:
            fits = F.size(F.array_except(F.coalesce(F.json_object_keys(value), F.array().cast("array<string>")), F.lit(kinds.names))) == 0
    checked = lines.select(parsed.alias("r"), fits.alias("fits")).withColumn("good", F.col("fits") & F.col("r.__bad").isNull())
    if checked.filter(~F.coalesce("good", F.lit(False))).limit(max_bad + 1).count() > max_bad:
        raise ValueError(f"more than {max_bad} rows don't fit")
    return checked.filter("good").select("r.*").drop("__bad")


def avro_paths(path) -> list[str]:
    """Paths of Avro files: one that doesn't end in .avro is a folder, whose Avro files are meant."""
    return [p if p.endswith(".avro") else f"{p.rstrip('/')}/*.avro" for p in ([path] if isinstance(path, str) else path)]


def comment_table(spark: SparkSession, table: str, doc: str | None) -> bool:
    """Set a schema's doc as its table's comment; a failure to do so is a warning. Whether it was set."""
    if not doc:
        return False
    try:
        spark.sql(f"COMMENT ON TABLE {table} IS :doc", args={"doc": doc})
    except Exception as e:
        warnings.warn(f"no comment on {table}: {e}", stacklevel=2)
        return False
    return True


def manifest(files: DataFrame) -> DataFrame:
    """One row per file of a manifest's entries: url and mandatory."""
    return files.select(F.col("path").alias("url"), F.lit(True).alias("mandatory"))


def write_manifest(spark: SparkSession, files: DataFrame, path: str) -> None:
    entries = [r.asDict() for r in manifest(files).orderBy("url").collect()]  # file names, as a manifest lists them
    fs, p = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps({"entries": entries}).encode()))
    out.close()


def read_manifest(spark: SparkSession, path: str, form: str = "text", **options) -> DataFrame:
    """Exactly the files that a manifest lists; a missing mandatory one is an error.

    What is there is found by one listing of the files' folders, not file by file.
    """
    entries = json.loads(spark.read.text(path, wholetext=True).first()[0])["entries"]
    wanted = spark.createDataFrame([(e["url"], bool(e.get("mandatory"))) for e in entries], "url string, mandatory boolean")
    folders = [f for f in sorted({e["url"].rsplit("/", 1)[0] for e in entries}) if exists(spark, f)]
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    there = list_files(spark, folders, recursive=False).select(bare("path").alias("__p")) if folders else spark.createDataFrame([], "__p string")
    found = wanted.withColumn("__p", bare("url")).join(there.distinct().withColumn("__there", F.lit(True)), "__p", "left").collect()
    lost = sorted(r["url"] for r in found if r["mandatory"] and not r["__there"])
    if lost:
        raise FileNotFoundError(f"missing: {lost[:5]}")
    return spark.read.options(**options).format(form).load(sorted(r["url"] for r in found if r["__there"]))


def merge_csv_parts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV parts with a header each as one table, in the order of the parts and of the lines in them."""
    bare = lambda c: F.regexp_replace(c, "^file:/*", "/")
    part = F.array_position(F.array(*(bare(F.lit(p)) for p in paths)), bare(F.col("_metadata.file_path")))
    rows = spark.read.csv(paths, header=True)
    placed = rows.select("*", part.alias("__part"), F.col("_metadata.file_block_start").alias("__at"), F.monotonically_increasing_id().alias("__n"))
    return placed.orderBy("__part", "__at", "__n").drop("__part", "__at", "__n")


def write_merged(df: DataFrame, path: str) -> None:
    """One CSV file with one header, in the order of ``df``: what is asked for is a single file, so one task writes it."""
    df.coalesce(1).write.csv(path, header=True)


def first_lines(spark: SparkSession, path: str, n: int | None = None, encoding: str = "UTF-8") -> DataFrame:
    """(file, line, value): the first n lines of each file, read from its first split; all without n, where
    lines beyond that split have no number."""
    lines = _with_heads(spark, path, encoding).withColumn("line", F.when(F.col("at") == 0, F.col("n") - F.col("head")))
    return (lines if n is None else lines.filter(F.col("line") < n).orderBy("file", "line")).select("file", "line", "value")
