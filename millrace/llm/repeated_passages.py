"""Repeated passages: bytes covered by a string of ``length`` bytes that also starts earlier, by bucket-pointer refinement.

A suffix counts by its first ``length`` bytes, its window. Initial buckets are by q-grams: a window goes to the bucket of
the q-gram in it whose hash is least, so that equal windows share a bucket, and neighbouring windows of one text mostly
share one as well and travel as one row, the bytes that they cover. Rows of a bucket with the same bytes are settled at
once: all but the first are repeated whole. Buckets with one row left hold no repeats. In the others suffixes get bucket
pointers, first by the q-gram they start with, then by sorting each bucket on the pointers found q bytes, and then 2q
bytes, further on: pointers are places in the suffix order, and each round sorts on those that the round before refined.

A bucket too large for one task is dealt anew: its windows go to buckets of longer q-grams, which fewer share, down to
that of the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, mix64, multipliers, row_key, written

LENGTH = 100
#: Bytes of text that are hashed at a time, whatever the length of a text, and rows that are compared before they are dealt.
SEGMENT, DEAL_ROWS = 1 << 19, 1 << 18
#: Rows of a bucket that are refined in one task, and bytes that are refined at a time.
BUCKET_ROWS, REFINE_BYTES = 8_192, 1 << 18
#: Rows of a batch that are taken out of Arrow at a time.
SLICE = 256
#: Texts whose q-grams are counted to find frequent ones (twice as many at most), and how many may be frequent. Frequent q-grams are taken only
#: where a window has no other; this moves rows between buckets and changes no result.
SAMPLE_TEXTS, MOST_FREQUENT = 20_000, 2_048
_LEAST_SEEN = 32
_ROLL = multipliers(64, 29)
_HOT = np.uint64(1 << 63)
#: Base of the hash of a row's bytes, and its inverse modulo 2**64.
_BASE = int(_ROLL[-1])
_INVERSE = pow(_BASE, -1, 1 << 64)


def gram_hashes(text: np.ndarray, q: int) -> np.ndarray:
    """The 64-bit hash of each run of ``q`` bytes, made of hashes of runs of 1, 2, 4, ... bytes."""
    n = len(text) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size, out, done, level = text.astype(np.uint64) + np.uint64(1), 1, None, 0, 0
    while size <= q:
        if q & size:
            part = h[done : done + n]
            out = part.copy() if out is None else out * _ROLL[32 + level] + part
            done += size
        if size * 2 <= q:
            h = h[: len(h) - size] * _ROLL[level] + h[size:]
            h ^= h >> np.uint64(31)
        size, level = size * 2, level + 1
    return mix64(out)


def window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n, size, m = len(h) - width + 1, 1, h
    while size * 2 <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return m[:n] if size == width else np.minimum(m[:n], m[width - size : width - size + n])


class Buckets:
    """Deals the windows of texts to buckets of q-grams."""

    def __init__(self, length: int, q: int, frequent: np.ndarray):
        self.length, self.q, self.frequent = length, q, np.sort(frequent)
        self.quick = np.zeros(1 << 16, bool)
        self.quick[(self.frequent & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.powers = np.ones(1, np.uint64)

    def least(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each q-gram, and of each window's bucket; the highest bit is set of frequent ones."""
        h = gram_hashes(text, self.q) & ~_HOT
        if len(self.frequent):
            maybe = np.flatnonzero(self.quick[(h & np.uint64(0xFFFF)).astype(np.int64)])
            x = h[maybe]
            at = np.minimum(np.searchsorted(self.frequent, x), len(self.frequent) - 1)
            h[maybe] = np.where(self.frequent[at] == x, x | _HOT, x)
        return h, window_least(h, self.length - self.q + 1)

    def rows(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(bucket, hash of the bytes, first window, windows) of rows, for texts laid end to end up to ``ends``.

        The windows of a row have their least q-gram, the first if there are several, at one place. So no two of them
        are equal, and there are as many as q-grams in a window at most.
        """
        h, least = self.least(text)
        n = len(least)
        starts = np.concatenate([[0], ends[:-1]])
        # Windows lie within one text.
        edge = np.zeros(n + 1, np.int64)
        long = ends - starts >= self.length
        np.add.at(edge, starts[long], 1)
        np.add.at(edge, np.minimum(ends[long] - self.length + 1, n), -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (h[: n - 1] == least[:-1])
        new[starts[long]] = True
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, n))
        first, count = first[inside[first]], count[inside[first]]
        return least[first], self._content(text, first, first + count + self.length - 1), first, count

    def _content(self, text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A hash of text[a:b] and its length, by sums of hashed runs of eight bytes times powers."""
        h = gram_hashes(text, 8)
        if len(self.powers) < len(h):
            with np.errstate(over="ignore"):
                self.powers = np.multiply.accumulate(np.full(len(h), np.uint64(_BASE)))
                self.inverse = np.multiply.accumulate(np.full(len(h), np.uint64(_INVERSE)))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h * self.powers[: len(h)])])
        return mix64((sums[b - 7] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64) * _ROLL[50])


def _segments(texts: list[bytes], places: list, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, text number, offset in it) of pieces of texts laid end to end, SEGMENT bytes or a little more at a
    time. A long text is cut so that each of its windows is whole in one piece. ``places``: for each text None, or the
    (first window, windows) runs that are wanted."""
    held, which, offset, size = [], [], [], 0
    for i, text in enumerate(texts):
        for a, n in [(0, len(text) - length + 1)] if places[i] is None else places[i]:
            for at in range(a, a + n, SEGMENT):
                piece = text[at : min(at + SEGMENT, a + n) + length - 1]
                held.append(piece), which.append(i), offset.append(at)
                size += len(piece)
                if size >= SEGMENT:
                    yield _laid(held, which, offset)
                    held, which, offset, size = [], [], [], 0
    if held:
        yield _laid(held, which, offset)


def _laid(held, which, offset):
    return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(p) for p in held]), np.array(which), np.array(offset, np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


_ROWS = "part long, bucket long, content long, doc long, row long, first int, windows int"


def _places(batch: pa.RecordBatch) -> list:
    return [sorted((x["first"], x["windows"]) for x in p) for p in batch["places"].to_pylist()] if "places" in batch.schema.names else [None] * batch.num_rows


def _runs(doc: np.ndarray, row: np.ndarray, place: np.ndarray, windows: np.ndarray) -> list[np.ndarray]:
    """Rows whose windows follow each other in a document, as one."""
    order = np.lexsort((place, row, doc))
    doc, row, place, windows = doc[order], row[order], place[order], windows[order]
    new = np.ones(len(order), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (place[1:] != place[:-1] + windows[:-1])
    head = np.flatnonzero(new)
    return [doc[head], row[head], place[head], np.add.reduceat(windows, head) if len(head) else windows]


def _told(bucket, content, doc, row, place, windows, again) -> pa.RecordBatch:
    """Rows that are first of their bytes with their bucket, and runs of the others without; these go anywhere."""
    spans = _runs(doc[again], row[again], place[again], windows[again])
    rest = [x[~again] for x in (doc, row, place, windows)]
    bucket, content, n = bucket[~again], content[~again], len(spans[0])
    # All rows of a bucket meet, but where its q-gram is frequent, those of the same bytes.
    part = np.where(bucket >= _HOT, mix64(bucket ^ content), bucket)
    part = np.concatenate([part, mix64(spans[1].view(np.uint64) + spans[2].astype(np.uint64))]).view(np.int64)
    none = np.concatenate([np.zeros(len(bucket), bool), np.ones(n, bool)])
    blank = np.zeros(n, np.uint64)
    cols = [pa.array(part), pa.array(np.concatenate([bucket, blank]).view(np.int64), mask=none), pa.array(np.concatenate([content, blank]).view(np.int64))]
    cols += [pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(rest, spans, strict=True), (np.int64, np.int64, np.int32, np.int32), strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=["part", "bucket", "content", "doc", "row", "first", "windows"])


def _deal(length: int, q: int, frequent: np.ndarray):
    """Rows of windows by bucket. Of rows of one bucket and the same bytes that meet here only the first is told with its
    bucket; the others are repeated, and told so by a null bucket."""

    def told(parts: list) -> pa.RecordBatch:
        bucket, content, doc, row, place, windows = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, row, doc, content, bucket))
        bucket, content, doc, row, place, windows = (x[order] for x in (bucket, content, doc, row, place, windows))
        again = np.zeros(len(order), bool)
        again[1:] = (bucket[1:] == bucket[:-1]) & (content[1:] == content[:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(order))))
        # A repeated row of documents is one document: the same place isn't its own repeat.
        again &= (doc != doc[head]) | (row != row[head]) | (place != place[head])
        return _told(bucket, content, doc, row, place, windows, again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, parts, n = Buckets(length, q, frequent), [], 0
        for batch in _slices(batches):
            docs, rows = batch["doc"].fill_null(2**63 - 1).to_numpy(), batch["row"].to_numpy()
            for text, ends, which, offset in _segments(as_bytes(batch["text"]), _places(batch), length):
                bucket, content, first, windows = buckets.rows(text, ends)
                piece = np.searchsorted(ends, first, side="right")
                place = first - np.concatenate([[0], ends[:-1]])[piece] + offset[piece]
                parts.append((bucket, content, docs[which[piece]], rows[which[piece]], place, windows))
                n += len(bucket)
                if n >= DEAL_ROWS:
                    yield told(parts)
                    parts, n = [], 0
        if parts:
            yield told(parts)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket, bytes and place: the repeated ones with a null bucket, and the first ones of buckets
    with more than one. What goes from one batch to the next is the last row, whatever the size of a bucket."""
    names = ["bucket", "content", "doc", "row", "first", "windows"]
    head: tuple | None = None  # the first row of the bytes at hand
    held: list = []  # that row, if it may still be alone in its bucket
    for batch in batches:
        cols = [batch[c].to_numpy() for c in names]
        if not len(cols[0]):
            continue
        bucket, content, doc, row, first, windows = cols
        n = len(bucket)
        other = np.ones(n, bool)
        other[1:] = (bucket[1:] != bucket[:-1]) | (content[1:] != content[:-1])
        if head is not None:
            other[0] = bucket[0] != head[0] or content[0] != head[1]
        at = np.maximum.accumulate(np.where(other, np.arange(n), -1))
        known = at >= 0
        same = ~other
        same[known] &= (doc[known] != doc[at[known]]) | (row[known] != row[at[known]]) | (first[known] != first[at[known]])
        if head is not None:
            same[~known] &= (doc[~known] != head[2]) | (row[~known] != head[3]) | (first[~known] != head[4])
        again = np.flatnonzero(same)
        new = np.flatnonzero(other)
        # The heads of this batch, after the one that is held; open are those beside another head of their bucket.
        out = [np.concatenate([np.array([h[i] for h in held], c.dtype), c[new]]) for i, c in enumerate(cols)]
        keys = out[0]
        beside = np.zeros(len(keys), bool)
        beside[1:] = keys[1:] == keys[:-1]
        shared = beside[1:].copy()
        beside[:-1] |= shared
        beside |= keys < 0  # buckets of frequent q-grams are dealt by their bytes as well: others may hold more of them
        if len(new) and not held and head is not None:
            beside[0] |= bucket[new[0]] == head[0]
        last_open = bool(beside[-1]) if len(beside) else False
        done = beside.copy()
        if len(new):
            j = new[-1]
            head = tuple(c[j].item() for c in cols)
            held = [] if last_open else [head]
        told = [np.concatenate([c[again], o[done]]) for c, o in zip(cols, out, strict=True)]
        mask = np.concatenate([np.ones(len(again), bool), np.zeros(int(done.sum()), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(told[0], mask=mask), *(pa.array(x) for x in told[2:])], names=["bucket", "doc", "row", "first", "windows"])


_SETTLED = "bucket long, doc long, row long, first int, windows int"


def refined(text: np.ndarray, ends: np.ndarray, length: int = LENGTH, q: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window, bucket pointer) of the windows of texts laid end to end that share their pointer with another one.

    A pointer is the place of a bucket in the order of suffixes. Initial buckets are q-grams, a quarter of the length;
    each round sorts the buckets on the pointers that their suffixes' later offsets have by then. Buckets of one suffix
    keep their pointer and are sorted no more.
    """
    q = q or max(1, -(-length // 4))
    room = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(len(text))
    h = gram_hashes(text, q)
    active = np.flatnonzero(room[: len(h)] >= q)
    pointer = np.full(len(text), -1, np.int64)
    key, depth = h[active], q
    while True:
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if depth == q:
            base = np.flatnonzero(new)[np.cumsum(new) - 1]
        else:
            # A bucket's parts lie where the bucket lay, in the order of the later pointers.
            old = pointer[active]
            whole = np.ones(len(old), bool)
            whole[1:] = old[1:] != old[:-1]
            begin = np.flatnonzero(new)[np.cumsum(new) - 1]
            base = old + begin - np.flatnonzero(whole)[np.cumsum(whole) - 1]
        pointer[active] = base
        alone = new & np.append(new[1:], True)
        active = active[~alone]
        if depth == length or not len(active):
            break
        step = min(depth, length - depth)
        # Suffixes too short for the next depth are no windows.
        active = np.sort(active[room[active] >= depth + step])
        # Sorting by the bucket, then by the later pointer: one number of both.
        key = pointer[active] * np.int64(len(text) + 1) + pointer[active + step]
        depth += step
    if not len(active):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(active), pointer[np.sort(active)]


def _refine(length: int):
    """Repeated windows (doc, row, first, windows) of rows sorted by bucket and place; whole buckets at a time."""

    def found(buckets: list, docs: list, rows: list, firsts: list, texts: list) -> pa.RecordBatch:
        # Repeated rows of documents are one: a place counts once.
        keep = [i for i in range(len(texts)) if not i or (buckets[i], docs[i], rows[i], firsts[i]) != (buckets[i - 1], docs[i - 1], rows[i - 1], firsts[i - 1])]
        text, ends = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8), np.cumsum([len(texts[i]) for i in keep], dtype=np.int64)
        window, pointer = refined(text, ends, length)
        # Rows are in the order of documents within a bucket, and equal windows are of one bucket: all but the first are repeated.
        order = np.argsort(pointer, kind="stable")
        again = np.zeros(len(order), bool)
        again[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
        window = window[again]
        piece = np.searchsorted(ends, window, side="right")
        new = np.ones(len(window), bool)
        new[1:] = (window[1:] != window[:-1] + 1) | (piece[1:] != piece[:-1])
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, len(window)))
        at = piece[head]
        source = np.array(keep, np.int64)[at] if len(keep) else at
        first = window[head] - (ends[at] - np.array([len(texts[i]) for i in keep], np.int64)[at]) + np.array(firsts, np.int64)[source] if len(head) else window[head]
        pick = lambda x: pa.array([x[i] for i in source.tolist()], pa.int64())
        return pa.RecordBatch.from_arrays([pick(docs), pick(rows), pa.array(first, pa.int32()), pa.array(count, pa.int32())], names=["doc", "row", "first", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[], [], [], [], []]
        size, last = 0, None
        for batch in _slices(batches):
            for values in zip(*(batch[c].to_pylist() for c in ("bucket", "doc", "row", "first", "text")), strict=True):
                if values[0] != last and size >= REFINE_BYTES:
                    yield found(*held)
                    held, size = [[], [], [], [], []], 0
                last = values[0]
                for h, v in zip(held, values, strict=True):
                    h.append(v)
                size += len(values[4])
        yield found(*held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "doc", "row", "first", "text"])


def _cut(length: int):
    """The bytes of wanted rows, out of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in _slices(batches):
            for doc, row, text, wanted in zip(batch["doc"].to_pylist(), batch["row"].to_pylist(), as_bytes(batch["text"]), batch["wanted"].to_pylist(), strict=True):
                for x in wanted:
                    cut = text[x["first"] : x["first"] + x["windows"] + length - 1]
                    held.append((x["bucket"], doc, row, x["first"], cut))
                    size += len(cut)
                    if size >= SEGMENT:
                        yield _batch(held)
                        held, size = [], 0
        yield _batch(held)

    return run


def _frequent(source: DataFrame, length: int, q: int) -> np.ndarray:
    """Hashes of q-grams that are taken for many windows in a sample of texts by a hash of the row."""
    texts = source.select("row").count()
    sample = source.filter(F.pmod(F.col("row"), F.lit(max(1, texts // SAMPLE_TEXTS))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, seen, size = Buckets(length, q, np.zeros(0, np.uint64)), [], 0

        def told() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["bucket", "n"])

        for batch in _slices(batches):
            for text, ends, _, _ in _segments(as_bytes(batch["text"]), [None] * batch.num_rows, length):
                seen.append(buckets.rows(text, ends)[0])
                size += len(seen[-1])
                if size >= DEAL_ROWS:
                    yield told()
                    seen.clear()
                    size = 0
        yield told()

    seen = sample.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    top = seen.filter(F.col("n") >= _LEAST_SEEN).orderBy(F.desc("n"), "bucket").limit(MOST_FREQUENT).collect()
    return np.array([r.bucket for r in top], np.int64).view(np.uint64)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, row, spans): for each document with repeated bytes the (first window, windows) runs of windows of ``length``
    bytes that also start earlier, in a document with a smaller id or further up in the same one. See ``drop_repeats``."""
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "text").filter(F.octet_length("text") >= length)
    order = ["bucket", "doc", "row", "first"]
    now, found = source, None
    for q in sorted({max(1, length // 4), max(1, length // 2), max(1, 3 * length // 4), length}):
        frequent = _frequent(source, length, q) if now is source else np.zeros(0, np.uint64)
        dealt = now.mapInArrow(_deal(length, q, frequent), _ROWS)
        # Rows that their task has settled go anywhere.
        placed = dealt.repartition("part").sortWithinPartitions("bucket", "content", "doc", "row", "first")
        settled = written(placed.drop("part").mapInArrow(_passed, _SETTLED), "settled")
        spans = settled.filter("bucket IS NULL").select("doc", "row", "first", "windows")
        found = spans if found is None else found.unionByName(spans)
        open_ = settled.filter("bucket IS NOT NULL")
        sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
        sizes = written(sizes.filter(F.col("n") > BUCKET_ROWS).select("bucket"), "large-buckets")
        more = not sizes.isEmpty()
        small = open_.join(sizes, "bucket", "left_anti") if more else open_
        texts = source.withColumn("doc", F.coalesce("doc", F.lit(2**63 - 1)))
        wanted = small.groupBy("doc", "row").agg(F.collect_list(F.struct("bucket", "first", "windows")).alias("wanted"))
        cut = texts.join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(_cut(length), "bucket long, doc long, row long, first int, text binary")
        refined_ = cut.repartition("bucket").sortWithinPartitions(*order).mapInArrow(_refine(length), "doc long, row long, first int, windows int")
        found = found.unionByName(written(refined_, "refined"))
        if not more:
            break
        places = open_.join(sizes, "bucket", "left_semi").groupBy("doc", "row").agg(F.collect_set(F.struct("first", "windows")).alias("places"))
        now = texts.join(places, ["doc", "row"]).select("doc", "row", "text", "places")
    return found.groupBy("doc", "row").agg(F.collect_list(F.struct("first", "windows")).alias("spans"))


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_settle``, past the rows that their task has settled: they have a null bucket and come first."""
    names = ["bucket", "doc", "row", "first", "windows"]

    def open_rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            none = batch["bucket"].is_null()
            if none.true_count:
                done.append(batch.filter(none).select(names))
            yield batch.filter(batch["bucket"].is_valid())

    done: list[pa.RecordBatch] = []
    for out in _settle(open_rows()):
        yield from done
        done.clear()
        yield out
    yield from done


def _drop(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for text, spans in zip(as_bytes(batch["text"]), batch["spans"].to_pylist(), strict=True):
                rest, end, n = [], 0, 0
                for first, windows in sorted((x["first"], x["windows"]) for x in spans or ()):
                    if first > end or not n:
                        rest.append(text[end:first])
                        n += 1
                    end = max(end, first + windows + length - 1)
                rest.append(text[end:])
                left = b"".join(rest)
                sizes.append(len(text)), removed.append(len(text) - len(left)), runs.append(n)
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            cols = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def drop_repeats(docs: DataFrame, length: int = LENGTH, keep_text: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, kept (binary).

    Texts are UTF-8 bytes, and null is empty. A byte goes if a string of ``length`` bytes covers it that also starts
    earlier: in a document of a smaller id, or in the same one further up, overlaps included. Strings are judged on the
    input, not on what is left; no string crosses documents, and a cut may fall inside a character. Documents of equal
    id come in the order of a hash of their text, a null id after all others; rows with equal id and text are one
    document and have the same result. Texts shorter than ``length`` keep all. Texts of any length are taken whole, in
    pieces of bounded size. Other columns are not looked at. An empty table gives no rows.
    """
    spans = repeated_spans(docs, length)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    keyed = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(2**63 - 1)))
    joined = keyed.join(spans, ["doc", "row"], "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return joined.mapInArrow(_drop(length, keep_text), schema)
