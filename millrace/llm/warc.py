"""WARC archives: records written and read as Spark jobs, and transactions assembled from their records.

A capture is a request, a response (or revisit) and a metadata record; the request and the metadata name the response
in WARC-Concurrent-To. ``assemble`` joins the three and gives one nested row per capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, made_folder, shared_path, written

CRLF = "\r\n"
VERSION = "WARC/1.1"
#: Uncompressed bytes that an archive holds at most, unless one capture is longer; a task reads one archive at a time.
#: Captures are archived with others of like size: up to a quarter of an archive and what their records add, then up to
#: a quarter of that, and so on.
ARCHIVE_BYTES, RECORD_BYTES, CLASSES = 16 << 20, 2_000, 7
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, fields map<string,string>, payload binary, payload_bytes long, computed_digest string, error string"
)
#: Bytes that are decompressed at a time, and the longest header of a record.
CHUNK, HEADER = 1 << 20, 1 << 30


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content: Column) -> Column:
    """The text of one record up to its closing blank lines, which the writer's line separator adds."""
    named = [F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in headers]
    named = [F.coalesce(x, F.lit("")) for x in named]  # a header without a value is left out
    return F.concat(
        F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}"),
        *named, F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit(CRLF * 2), content,
    )


def _uri(name: str, uid: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{name}:"), uid.cast("string"), F.lit(">"))


def write_captures(pages: DataFrame, path: str, least_bytes: int = 1000) -> None:
    """Write request, response or revisit, and metadata records of page_id, url and html as gzip WARC files.

    Of equal payloads of ``least_bytes`` or more, the one with the largest page_id is a response and the others are
    revisits that name it and carry no payload. Null html is empty; a null page_id is less than any other, and
    payloads whose ids are all null are all responses, as are repeated rows of the largest id. Line breaks in a url
    become spaces. Pages and urls of any length are written whole; an archive has ARCHIVE_BYTES at most, or one capture.
    Columns beyond the three are left out. An empty table writes no archive.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    # Written once, so that both uses below see one id for a row; by size, so that each size is read alone.
    base = pages.select(F.monotonically_increasing_id().alias("uid"), F.col("page_id").cast("long").alias("page_id"), F.regexp_replace("url", r"[\r\n]+", " ").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    whole = F.col("bytes") + 4 * F.coalesce(F.octet_length("url"), F.lit(0)) + RECORD_BYTES
    base = base.withColumn("class", sum((whole <= ARCHIVE_BYTES >> 2 * k).cast("int") for k in range(1, CLASSES + 1)))
    folder = shared_path(spark, "warc-pages")
    base.write.partitionBy("class").parquet(folder)
    base = spark.read.schema(base.schema).parquet(folder)
    same = base.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes")
    groups = same.agg(F.count(F.lit(1)).alias("copies"), F.max(F.struct("page_id", "uid")).alias("head"))
    groups = written(groups.filter((F.col("copies") > 1) & F.col("head.page_id").isNotNull()).select("digest", "bytes", "head"), "warc-groups")
    for r in base.select("class").distinct().collect():  # CLASSES + 1 at most
        df = attach(base.filter(F.col("class") == r["class"]), groups, "digest", "bytes", how="left")
        most = 4 ** r["class"]  # each has a 4**class-th of an archive at most
        writer = _records(df).write.option("lineSep", CRLF * 2).option("maxRecordsPerFile", 3 * most).option("compression", "gzip")
        writer.text(f"{path}/size-{r['class']}")


def _records(df: DataFrame) -> DataFrame:
    """The text of each capture's request, response or revisit, and metadata records, one after the other."""
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head.page_id"))

    uri = F.col("url")
    own = _uri("response", F.col("uid"))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    http = lambda n: F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), n.cast("string"), F.lit(CRLF * 2))
    kind = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", own, kind, F.concat(http(F.col("bytes")), F.col("html")))
    refers = [("WARC-Refers-To", _uri("response", F.col("head.uid"))), ("WARC-Profile", F.lit(PROFILE))]
    again = _record("revisit", own, kind + refers, http(F.col("bytes")))
    request = _record("request", _uri("request", F.col("uid")), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF * 2}")))
    about = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("fetched-bytes: "), F.col("bytes").cast("string"), F.lit(CRLF))
    metadata = _record("metadata", _uri("metadata", F.col("uid")), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], about)
    return df.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))


def _content(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, or the data itself, CHUNK compressed bytes at a time."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + CHUNK]) for i in range(0, len(data), CHUNK))
        return
    while at < len(data):
        member, tail = zlib.decompressobj(31), b""
        while not member.eof and (tail or at < len(data)):
            part = tail or view[at : at + CHUNK]
            yield member.decompress(part, CHUNK)
            at += 0 if tail else len(part)
            at, tail = at - len(member.unused_data), member.unconsumed_tail
        if not member.eof:
            raise ValueError("truncated gzip member")


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (lower-case names) and block of each record, cut by Content-Length, and what is wrong with it.

    After a record whose header can't be read, reading goes on at the next one. A file that ends early or can't be
    decompressed ends with a record that says so and has what there is of its block.
    """
    buffer, failed = bytearray(), []

    def more() -> bool:
        try:
            chunk = next(chunks, None)
        except (zlib.error, ValueError) as e:
            failed.append(str(e))
            return False
        buffer.extend(chunk or b"")
        return chunk is not None

    def find(what: bytes, start: int, most: int) -> int:
        while (at := buffer.find(what, start)) < 0 and len(buffer) - start <= most:
            start = max(start, len(buffer) - len(what))
            if not more():
                return -1
        return at

    def skip() -> None:
        """Drop what comes before the next record."""
        while find(b"WARC/", 1, CHUNK) < 0:
            if len(buffer) > 5:
                del buffer[:-5]
            if not more():
                buffer.clear()
                return
        del buffer[: buffer.find(b"WARC/", 1)]

    while True:
        while (blank := len(buffer) - len(buffer.lstrip(b"\r\n"))) == len(buffer) and more():
            pass
        del buffer[:blank]
        if not buffer:
            break
        end = find(b"\r\n\r\n", 0, HEADER)
        lines = bytes(buffer[: max(end, 0)]).decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = fields.get("content-length", "")
        if end < 0 or not buffer.startswith(b"WARC/") or not (length.isascii() and length.isdigit()):
            yield fields, b"", "no header" if end < 0 else "no record" if not buffer.startswith(b"WARC/") else "no length"
            skip()
            continue
        start, stop = end + 4, end + 4 + int(length)
        while len(buffer) < stop and more():
            pass
        yield fields, bytes(buffer[start:stop]), None if len(buffer) >= stop else "truncated"
        del buffer[:stop]
    if failed:
        yield {}, b"", failed[0]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string()), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        for content in batch["content"]:
            rows, size = [], 0
            for f, block, error in parse_records(_content(content.as_py())):
                kind, extra, payload = f.get("warc-type"), {}, block
                if f.get("content-type", "").startswith("application/http"):
                    payload = block.partition(b"\r\n\r\n")[2]
                elif f.get("content-type", "").startswith("application/warc-fields"):
                    extra = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n") if x)}
                digest = hashlib.sha1(payload).hexdigest() if kind == "response" else None
                rows.append((f.get("warc-record-id"), kind, f.get("warc-target-uri"), f.get("warc-date"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-payload-digest"), list(extra.items()), payload, len(payload), digest, error))
                size += len(payload)
                if size > 8 << 20:
                    yield batch_of(rows)
                    rows, size = [], 0
            yield batch_of(rows)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files (gzip or plain) under ``path``. ``error`` says what is wrong with a damaged
    one: no record, no header, no length, truncated, or why a file couldn't be decompressed further. One task reads a
    file, which Spark's binary source takes up to 2 GB compressed; it is decompressed CHUNK bytes at a time, and records
    leave it in batches of about 8 MB. An empty folder gives no rows."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(_parse, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response, request and metadata structs (null where a capture has none).

    Requests and metadata are joined to the response that they name in WARC-Concurrent-To by one grouping. Those that
    name none, and damaged records, are left out; of several records of a part the greatest by digest, date and id is
    taken. Structs have the columns of ``records`` but for concurrent_to and error, so that a payload that isn't asked
    for can be dropped before.
    """
    own = F.col("type").isin("response", "revisit")
    whole = F.struct(*(c for c in records.columns if c not in ("concurrent_to", "error")))
    order = F.struct("payload_digest", "date", "record_id")
    part = lambda name, kinds: F.max_by(whole, F.when(F.col("type").isin(*kinds), order)).alias(name)
    keyed = records.filter("error IS NULL").withColumn("capture_id", F.when(own, F.col("record_id")).otherwise(F.col("concurrent_to"))).filter("capture_id IS NOT NULL")
    captures = keyed.groupBy("capture_id").agg(part("response", ("response", "revisit")), part("request", ("request",)), part("metadata", ("metadata",)))
    return captures.filter("response IS NOT NULL")


def page_captures(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back, assemble the captures and resolve revisits.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri. Digest and size of a
    response are those of the payload read back; a revisit has those of the response that it refers to. Repeated rows
    each get a row. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    made_folder(spark, path)
    write_captures(pages, path)
    captures = assemble(read_warc(spark, path).drop("payload"))
    flat = captures.select(
        "capture_id", F.col("response.type").alias("record_type"), F.col("response.refers_to").alias("to"), F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.col("response.payload_bytes").alias("bytes"), F.col("response.computed_digest").alias("digest"), F.col("response.target_uri").alias("target_uri"),
    )
    flat = written(flat, "captures")
    named = flat.filter(F.col("record_type") == "revisit").select(F.col("to").alias("__named")).distinct()
    heads = flat.filter(F.col("record_type") == "response").join(named, F.col("capture_id") == F.col("__named"), "left_semi")
    heads = written(heads.select(F.col("capture_id").alias("to"), F.col("page_id").alias("head_id"), F.col("bytes").alias("head_bytes"), F.col("digest").alias("head_digest")), "warc-heads")
    out = attach(flat, heads, "to", how="left")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "page_id", F.when(revisit, F.col("head_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), F.when(revisit, F.col("head_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", F.when(revisit, F.col("head_id")).alias("refers_to"), "target_uri",
    )
