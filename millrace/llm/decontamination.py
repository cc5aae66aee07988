"""Benchmark decontamination by spaced seeds.

A mask of fixed places says which of a window's tokens are hashed and which are ignored, so that a window matches
even where an ignored token was replaced. Windows of documents and of benchmark items are hashed under every mask and
joined; where a stretch of a document and an item meet, each hit names a diagonal (document place minus item place), along
which the tokens around the hit are compared and scored, replaced tokens included. A stretch meets an item in one row,
however many windows and diagonals they share. Short items are hashed over windows of their own length, under masks
that together find every copy with as few replaced tokens as are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, mix64, multipliers, row_key, words_of, written

#: Fixed masks over windows of SPAN tokens: places that are hashed.
MASKS = ((0, 1, 3, 6, 8, 9), (0, 2, 3, 5, 7, 9), (0, 1, 4, 5, 8, 9), (0, 2, 4, 6, 7, 9))
SPAN = 10
#: Tokens looked at on either side of a hit.
REACH = 64
#: A replaced token costs this many matching ones, so that a stretch's sum isn't negative if and only if its share of
#: equal ones is LEAST_SHARE or more.
MISMATCH = 4
#: An overlap counts from this many tokens on (or the whole item, if that is shorter), with this share of equal ones.
LEAST_TOKENS, LEAST_SHARE = 13, 0.8
#: Marks at the ends of words that are no part of a token.
MARKS = b".,;:!?\"'()[]{}#*$%&|<>=-_"
#: Longs of the filter that benchmark hashes are entered in, 2 to 32 MB by the number of hashes: 16 bits for each hash, up
#: to 17 million of them; beyond that it lets through more hits than there are, which the join drops.
FILTER_WORDS, MOST_FILTER_WORDS = 1 << 18, 1 << 22

_MULT = multipliers(4 * SPAN, 7)


def tokens_of(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of the words, lower-cased, without marks at their ends; words of marks alone are left out."""
    t = hashes.of(words_of(text))
    return t[t != 0]


def allowed(n: int) -> int:
    """How many of ``n`` tokens may be replaced."""
    return int((1 - LEAST_SHARE) * n + 1e-9)


def _short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over all ``n`` tokens of a short item. Cut into 2r + 1 runs, each mask leaves r of them out, so that
    wherever r tokens are replaced, one mask has none of them."""
    r = allowed(n)
    runs = np.array_split(np.arange(n), 2 * r + 1)
    return [tuple(int(p) for k in kept for p in runs[k]) for kept in combinations(range(2 * r + 1), r + 1)]


def _masks(n: int) -> tuple[int, list[tuple[int, ...]]]:
    """Window and masks of an item of ``n`` tokens."""
    return (SPAN, list(MASKS)) if n >= LEAST_TOKENS else (n, _short_masks(n))


def seeds(tokens: np.ndarray, n: int) -> list[np.ndarray]:
    """For each mask of items of ``n`` tokens the hash of each window."""
    span, masks = _masks(n)
    windows = len(tokens) - span + 1
    if n < 1 or windows <= 0:
        return []
    out = []
    for number, mask in enumerate(masks):
        h = np.full(windows, mix64(np.array([1000 * span + number + 1], np.uint64))[0])
        for place in mask:
            h = h + tokens[place : place + windows] * _MULT[place]
        out.append(mix64(h))
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes(MARKS)
    for batch in batches:
        toks = [tokens_of(t, hashes) for t in as_bytes(batch["text"])]
        found = [seeds(t, len(t)) or [np.zeros(0, np.uint64)] for t in toks]
        flat = [np.concatenate(x).view(np.int64) for x in found]
        places = [np.concatenate([np.arange(len(y), dtype=np.int32) for y in x]) for x in found]
        yield pa.RecordBatch.from_arrays(
            [batch["item"], pa.array([t.view(np.int64) for t in toks], pa.list_(pa.int64())), pa.array(flat, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
            names=["item", "tokens", "h", "at"],
        )


def _filter_bits(h: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    bits = np.uint64(words * 64 - 1)
    return h & bits, (h >> np.uint64(32)) & bits


def benchmark_filter(seeds_: DataFrame) -> np.ndarray:
    """Two bits for each benchmark hash in a power of two of longs, made by a bit-or over all items: at most 32 MB."""
    n = seeds_.count()
    most = FILTER_WORDS
    while most < min(n // 4, MOST_FILTER_WORDS):
        most *= 2
    size = most * 64
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1)))).alias("bit")
    words = seeds_.select(bit).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    table = np.zeros(most, np.uint64)
    found = words.toPandas()
    table[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).view(np.uint64)
    return table


def _hits(table, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, words = WordHashes(MARKS), table.value
        for batch in batches:
            rows = []
            for doc, row, text in zip(batch["doc_id"].to_pylist(), batch["row"].to_pylist(), as_bytes(batch["text"]), strict=True):
                t = tokens_of(text, hashes)
                at, hs = [], []
                for h in (h for n in sizes for h in seeds(t, n)):
                    a, b = _filter_bits(h, len(words))
                    one = np.uint64(1)
                    low = np.uint64(63)
                    hit = np.flatnonzero((words[(a >> np.uint64(6)).astype(np.int64)] >> (a & low)) & (words[(b >> np.uint64(6)).astype(np.int64)] >> (b & low)) & one)
                    at.append(hit)
                    hs.append(h[hit])
                if not at:
                    continue
                at, hs = np.concatenate(at), np.concatenate(hs)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, hs = at[order], hs[order]
                # Hits whose surroundings overlap share one stretch of tokens.
                cuts = np.flatnonzero(np.diff(at) > 2 * REACH) + 1
                for place, h in zip(np.split(at, cuts), np.split(hs, cuts), strict=True):
                    a, b = max(0, int(place[0]) - REACH), min(len(t), int(place[-1]) + SPAN + REACH)
                    rows.append((doc, row, a, t[a:b].view(np.int64), (place - a).astype(np.int32), h.view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row", "start", "tokens", "at", "h"])

    return run


def best_stretch(same: np.ndarray, least: int) -> tuple[int, int, int]:
    """(equal, start, end) of the longest stretch of a diagonal that begins and ends with equal tokens, LEAST_SHARE or
    more of them equal; the first of the longest. Zeros if it has fewer than ``least`` tokens."""
    run = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0, 0
    # The highest sum at any end from a place on: a start's stretch goes as far as that isn't below its own sum.
    ends = np.concatenate([[-np.inf], np.where(same, run[1:], -np.inf)])
    high = np.maximum.accumulate(ends[::-1])[::-1]
    end = np.searchsorted(-high, -run[starts], side="right") - 1
    k = int(np.argmax(end - starts))
    s, e = int(starts[k]), int(end[k])
    return (int(same[s:e].sum()), s, e) if e - s >= least else (0, 0, 0)


def diagonals(doc_h: np.ndarray, doc_at: np.ndarray, item_h: np.ndarray, item_at: np.ndarray, n: int, m: int) -> np.ndarray:
    """Document place minus item place of all equal hashes of a stretch of ``n`` tokens and an item of ``m``, each once."""
    seen = np.zeros(n + m + 1, bool)
    order = np.argsort(doc_h, kind="stable")
    doc_h, doc_at = doc_h[order], doc_at[order].astype(np.int64) + m
    low, high = np.searchsorted(doc_h, item_h), np.searchsorted(doc_h, item_h, side="right")
    for a, b, at in zip(low.tolist(), high.tolist(), item_at.tolist(), strict=True):
        if a < b:
            seen[doc_at[a:b] - at] = True
    return np.flatnonzero(seen) - m


def longest_overlap(doc: np.ndarray, item: np.ndarray, along: np.ndarray) -> tuple[int, int, int] | None:
    """(overlap, equal, at) of the best stretch of all diagonals: the longest, with most equal tokens, the first."""
    best = None
    n = len(item)
    for diagonal in along.tolist():
        a, b = max(0, -diagonal), min(n, len(doc) - diagonal)
        if best is not None and b - a < best[0]:
            continue
        same = doc[a + diagonal : b + diagonal] == item[a:b]
        if n < LEAST_TOKENS:
            equal, s, e = int(same.sum()), 0, b - a
            equal = equal if e == n and equal >= n - allowed(n) else 0
        else:
            equal, s, e = best_stretch(same, LEAST_TOKENS)
        if equal:
            found = (e - s, equal, -(a + diagonal + s))
            best = found if best is None else max(best, found)
    return best and (best[0], best[1], -best[2])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrays = lambda batch, name: [x.values.to_numpy() for x in batch[name]]
    for batch in batches:
        keep, told = [], []
        rows = zip(*(arrays(batch, c) for c in ("tokens", "h", "at", "item_tokens", "item_h", "item_at")), batch["start"].to_pylist(), strict=True)
        for i, (doc, h, at, item, item_h, item_at, start) in enumerate(rows):
            found = longest_overlap(doc, item, diagonals(h, at, item_h, item_at, len(doc), len(item)))
            if found:
                keep.append(i)
                told.append((found[1], found[0], start + found[2]))
        ids = batch.take(pa.array(keep, pa.int64()))
        cols = list(zip(*told, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([ids["doc_id"], ids["row"], ids["item"], pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["doc_id", "row", "item", "equal", "overlap", "at"])


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that overlap: doc_id, row, item_id, equal, overlap, at.

    ``overlap`` tokens from token ``at`` of the document on match the item along one diagonal, ``equal`` of them
    exactly. Tokens are looked at as far as REACH beyond a text's outermost hits: an overlap that goes on further than
    that without a hit is told shorter than it is. An item of fewer than LEAST_TOKENS tokens matches whole, with as many
    replaced tokens as ``allowed`` (none below five). Null and empty texts and items without tokens match nothing. Texts
    of any length are searched whole; one of a repeated word, or of a passage many times over, makes one row with each
    item that it meets. Repeated documents share ``row`` and one result; repeated items are one; of several matches of a
    document and an item the longest is told, then the one with most equal tokens, then the first. Other columns are not
    looked at. An empty table on either side gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    bench = benchmark.select(F.col("item_id"), row_key(F.col("item_id"), F.col("text")).alias("item"), "text").dropDuplicates(["item"])
    items = written(bench.select("item", "text").mapInArrow(_items, "item long, tokens array<long>, h array<long>, at array<int>"), "bench-items")
    item_seeds = items.select("item", F.explode(F.array_distinct("h")).alias("h"))
    table = spark.sparkContext.broadcast(benchmark_filter(item_seeds))
    lengths = items.select(F.least(F.size("tokens"), F.lit(LEAST_TOKENS)).alias("n")).filter("n > 0").distinct()
    sizes = sorted(r.n for r in lengths.collect())  # LEAST_TOKENS at most; one stands for all longer items
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    schema = "doc_id long, row long, start long, tokens array<long>, at array<int>, h array<long>"
    parts = written(source.mapInArrow(_hits(table, sizes), schema), "seed-hits")
    # A hash counts once for a stretch and once for an item, however often it stands there.
    hits = parts.select("row", "start", F.explode(F.array_distinct("h")).alias("h"))
    meet = hits.join(item_seeds, "h").select("row", "start", "item").distinct()
    texts = parts.dropDuplicates(["row", "start"])
    sides = items.select("item", F.col("tokens").alias("item_tokens"), F.col("h").alias("item_h"), F.col("at").alias("item_at"))
    pairs = meet.join(texts, ["row", "start"]).join(sides, "item")
    found = pairs.select("doc_id", "row", "start", "item", "tokens", "h", "at", "item_tokens", "item_h", "item_at").mapInArrow(_verify, "doc_id long, row long, item long, equal int, overlap int, at long")
    best = found.groupBy("row", "item").agg(F.max(F.struct("overlap", "equal", -F.col("at"), "doc_id")).alias("b"))
    named = best.join(bench.select("item", "item_id"), "item")
    return named.select(F.col("b.doc_id").alias("doc_id"), "row", "item_id", F.col("b.equal").alias("equal"), F.col("b.overlap").alias("overlap"), (-F.col("b.col3")).alias("at"))
