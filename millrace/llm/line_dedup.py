"""Line deduplication over range-partitioned hashes with a secondary sort.

Lines leave their texts as (hash, document, position). They are range-partitioned by (hash, document), so that a line
found in a third of all documents is spread over many tasks, and sorted by (hash, document, position) inside. One
stream through each partition finds first occurrences and counts documents by hash. Only the hashes at a partition's
edges can go on in another partition: their counts are added up in a table of a few rows per partition. What returns
is a compressed bitmap of kept lines for each document that loses any.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, row_key, written

#: What is stripped from both ends of a line's key.
SPACES = b" \t\n\x0b\x0c\r"
_LINES = "row long, doc long, pos int, h long"
_FOUND = "kind int, h long, row long, doc long, pos int, first boolean, n long"
DROP, MAYBE, COUNT = 0, 1, 2


def _lines(least_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs, pos, hashes = [], [], [], []
            for row, doc, text in zip(batch["row"].to_pylist(), batch["doc"].to_pylist(), as_bytes(batch["text"]), strict=True):
                for i, line in enumerate(text.lower().split(b"\n")):
                    key = line.strip(SPACES)
                    if len(key) >= least_points and (least_points <= 1 or len(key.decode()) >= least_points):
                        rows.append(row)
                        docs.append(doc)
                        pos.append(i)
                        hashes.append(xxhash.xxh3_64_intdigest(key))
            h = np.array(hashes, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(pos, pa.int32()), pa.array(h)], names=["row", "doc", "pos", "h"])

    return run


def _stream(least_docs: int):
    """Runs of equal hashes in a sorted partition. A run's lines wait only until it has ``least_docs`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        h = doc = first = None
        docs, waiting, at_edge = 0, [], True

        def close(edge: bool) -> None:
            if h is None:
                return
            if edge:
                out.append((COUNT, h, None, None, None, None, docs))
                out.extend((MAYBE, h, *x, None) for x in waiting)

        for batch in batches:
            hs, ds, rs, ps = (batch[c].to_numpy(zero_copy_only=False) for c in ("h", "doc", "row", "pos"))
            starts = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]]) if len(hs) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(hs)] if len(hs) else starts
            # A run of fewer lines than documents asked for, whole inside this batch, is of no interest.
            for k in np.flatnonzero((ends - starts >= least_docs) | (starts == 0) | (ends == len(hs))):
                a, b = int(starts[k]), int(ends[k])
                if h is None or hs[a] != h:
                    close(at_edge)
                    at_edge = h is None
                    h, doc, docs, waiting, first = int(hs[a]), None, 0, [], None
                for i in range(a, b):
                    if doc is None or ds[i] != doc:
                        docs, doc = docs + 1, ds[i]
                    if first is None:
                        first = (rs[i], ps[i])
                    is_first = (rs[i], ps[i]) == first
                    if docs >= least_docs and not at_edge:
                        if waiting:
                            out.extend((DROP, h, *x, None) for x in waiting)
                            waiting = []
                        out.append((DROP, h, int(rs[i]), int(ds[i]), int(ps[i]), is_first, None))
                    else:
                        waiting.append((int(rs[i]), int(ds[i]), int(ps[i]), is_first))
                    if len(waiting) >= 10_000 and at_edge:
                        out.extend((MAYBE, h, *x, None) for x in waiting)
                        waiting = []
                if len(out) > 20_000:
                    yield _batch(out)
                    out.clear()
        # The last run may go on in the next partition; so may the first lines of a run be in the one before.
        close(True)
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["kind", "h", "row", "doc", "pos", "first", "n"])


def dropped_lines(docs: DataFrame, least_docs: int = 10, least_points: int = 1, keep: str = "none") -> DataFrame:
    """(row, pos) of lines to drop: those whose key is in ``least_docs`` or more documents.

    ``keep``: "none" drops them everywhere, "first" leaves the first by (doc_id, position). A key is the line with
    ASCII white space stripped and A-Z lower-cased; keys shorter than ``least_points`` code points stay. ``row`` is
    ``row_key(doc_id, text)``: repeated rows share it and are one document, as are rows with one doc_id.
    """
    source = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), "text")
    lines = source.mapInArrow(_lines(least_points), _LINES)
    ordered = lines.repartitionByRange("h", "doc").sortWithinPartitions("h", "doc", "pos", "row")
    found = written(ordered.mapInArrow(_stream(least_docs), _FOUND), "line-runs")
    # Two counts a partition of the sort at most, whatever the input: both tables of hashes below are small enough to
    # broadcast, and the lines of a frequent hash stay where they are.
    edges = found.filter(F.col("kind") == COUNT).groupBy("h").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= least_docs)
    maybe = found.filter(F.col("kind") == MAYBE).join(F.broadcast(edges), "h")
    sure = found.filter(F.col("kind") == DROP)
    if keep == "first":
        # A hash at an edge has a candidate first line in each of its partitions, sure to go or not; the least document's
        # is the first. One row a partition and hash is flagged, so that these are as few as the edges.
        flagged = found.filter(F.col("first") & F.col("kind").isin(DROP, MAYBE)).join(F.broadcast(edges), "h")
        heads = flagged.groupBy("h").agg(F.min(F.struct("doc", "pos", "row")).alias("head"))
        is_head = (F.col("row") == F.col("head.row")) & (F.col("pos") == F.col("head.pos"))
        maybe = maybe.join(F.broadcast(heads), "h").filter(~is_head)
        # A hash that lies in one partition has no head among the edges': its own flag says which line stays.
        sure = sure.join(F.broadcast(heads), "h", "left").filter(~F.when(F.isnotnull("head"), is_head).otherwise(F.col("first")))
    return sure.select("row", "pos").unionByName(maybe.select("row", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch["places"].to_pylist():
            keep = np.ones(max(places) // 8 * 8 + 8, bool)  # whole bytes, so that no padding reads as a drop
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(maps, pa.binary())], names=["row", "bitmap"])


def keep_bitmaps(docs: DataFrame, **options) -> DataFrame:
    """(row, bitmap) of documents that lose lines: zlib-compressed bits, 1 for a kept line, up to the last dropped one."""
    places = dropped_lines(docs, **options).groupBy("row").agg(F.collect_set("pos").alias("places"))
    return places.mapInArrow(_bitmaps, "row long, bitmap binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, totals, drops = [], [], []
        for text, bitmap in zip(as_bytes(batch["text"]), batch["bitmap"].to_pylist(), strict=True):
            lines = text.split(b"\n")
            totals.append(len(lines))
            kept = lines
            if bitmap is not None:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
                kept = [x for i, x in enumerate(lines) if i >= len(keep) or keep[i]]
            drops.append(len(lines) - len(kept))
            texts.append(b"\n".join(kept))
        rest = [batch[c] for c in batch.schema.names if c not in ("text", "bitmap")]
        names = [c for c in batch.schema.names if c not in ("text", "bitmap")]
        new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(totals, pa.int64()), pa.array(drops, pa.int64()), batch["bitmap"]]
        yield pa.RecordBatch.from_arrays([*rest, *new], names=[*names, "kept_text", "n_lines", "n_dropped", "bitmap"])


def dedup_lines(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """The columns in ``carry``, kept_text, n_lines (before dropping), n_dropped and the bitmap (null: all kept).

    Null and empty text is one empty line, whose key is empty and stays at the default ``least_points``. Repeated
    rows each come back, with the same bitmap. Texts of any length are cut whole. Columns that aren't carried may have
    any name. An empty table gives no rows.
    """
    maps = keep_bitmaps(docs, **options)
    keyed = docs.select(*carry, "text", row_key(F.col("doc_id"), F.col("text")).alias("__row"))
    joined = keyed.join(maps.withColumnRenamed("row", "__row"), "__row", "left").drop("__row").select(*carry, "text", "bitmap")
    types = ", ".join(f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(_apply, f"{types}, kept_text string, n_lines long, n_dropped long, bitmap binary")
