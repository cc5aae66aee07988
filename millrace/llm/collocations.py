"""Collocations: phrases whose words stand together far more often than apart, counted over a prefix-free parse.

Texts are cut into pieces at marks, and pieces into chunks where a window of OVERLAP words has a hash that triggers a
cut, so that repeated passages are cut alike wherever they stand. A chunk ends with its trigger and the next one begins
with it; the distinct chunks are the dictionary, and how often each occurs in the parse is its frequency. N-grams are
counted in distinct chunks only, each times the chunk's frequency. One that starts in the words that a chunk shares with
the next is left to the next one, where it is whole, so that every occurrence counts once.

Words are counted first. Pairs of frequent words are then summed by the hashes of both words, which name the words again
once few pairs are left. The runs of words all of whose pairs are frequent are summed by their text. Triples are counted
in them by hash alone, and only phrases all of whose triples are frequent are told, and summed, by their text, so that
these rows are about the phrases that are found. What tasks are told of frequent words, pairs and triples is a filter of
fixed size that never misses one, so that the counts are exact. Frequent words are told apart by 64 bits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, attach, mix64, multipliers, shared_path, written

#: Words that two chunks share: one fewer than a phrase can have.
OVERLAP, LONGEST = 4, 5
#: One window of words in so many is a trigger, so that chunks of long pieces have about as many words beside the overlap.
TRIGGER = 16
#: Longs of a filter: 16 MB, whatever it holds. Two bits an n-gram.
FILTER_WORDS = 1 << 21
#: Bytes of text that are parsed, and of chunks and runs that are counted, at a time.
BATCH_BYTES, COUNT_BYTES = 4 << 20, 2 << 20
#: Texts that are taken out of an Arrow batch, pairs that are summed, and rows that are returned, at a time: what a worker
#: holds, and what the executor's JVM holds of its rows beside its heap, depends on these and not on Spark's batches.
TEXT_ROWS, PAIR_ROWS, OUT_ROWS = 128, 1 << 19, 1 << 15
_PIECES = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n\n\n\n\n\n\n\n\n\n abcdefghijklmnopqrstuvwxyz")
_PLACE = multipliers(8, 23)


class Hashes(dict):
    """Word to 64-bit hash, remembered for up to ``keep`` words."""

    def __init__(self, keep: int = 1 << 17):
        self.keep = keep

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.keep:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def combined(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` words."""
    k = max(len(h) - n + 1, 0)
    out = np.full(k, np.uint64(n))
    for i in range(n):
        out = out + h[i : i + k] * _PLACE[i]
    return mix64(out)


#: What stands at the end of a chunk whose piece goes on.
_ON = b"\n"


def chunks_of(pieces: list[list[bytes]], hashes: Hashes, trigger: int = TRIGGER) -> list[bytes]:
    """The words of each chunk, with _ON behind them if the piece goes on; pieces too short for a cut are one."""
    least = 2 * OVERLAP + 1
    found = [b" ".join(p) for p in pieces if len(p) < least]
    long = [p for p in pieces if len(p) >= least]
    if not long:
        return found
    ends = np.cumsum([len(p) for p in long])
    cut = combined(hashes.of([w for p in long for w in p]), OVERLAP) % np.uint64(trigger) == 0
    places = np.flatnonzero(cut)
    firsts = ends - [len(p) for p in long]
    lows, highs = np.searchsorted(places, firsts), np.searchsorted(places, ends - OVERLAP)
    for p, first, lo, hi in zip(long, firsts.tolist(), lows.tolist(), highs.tolist(), strict=True):
        start = 0
        for at in (places[lo:hi] - first).tolist():
            if at - start >= OVERLAP:
                found.append(b" ".join(p[start : at + OVERLAP]) + _ON)
                start = at
        found.append(b" ".join(p[start:]))
    return found


def _cut(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, none of them empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()

    def told(found: dict[str, Counter]) -> pa.RecordBatch:
        chunks = [c for x in found.values() for c in x]
        last = [not c.endswith(_ON) for c in chunks]
        text = pa.array([c.rstrip(_ON) for c in chunks], pa.binary()).cast(pa.string())
        lang = [lang for lang, x in found.items() for _ in x]
        n = [n for x in found.values() for n in x.values()]
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), text, pa.array(last, pa.bool_()), pa.array(n, pa.int64())], names=["lang", "chunk", "last", "n"])

    found: dict[str, Counter] = {}
    size = 0
    for batch in _cut(batches, TEXT_ROWS):
        for lang, text in zip(batch["lang"].to_pylist(), as_bytes(batch["text"]), strict=True):
            pieces = [w for w in map(bytes.split, text.translate(_PIECES).split(b"\n")) if w]
            found.setdefault(lang, Counter()).update(chunks_of(pieces, hashes))
            size += len(text)
            if size >= BATCH_BYTES:
                yield from _cut([told(found)], OUT_ROWS)
                found, size = {}, 0
    yield from _cut([told(found)], OUT_ROWS)


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, last, n): the distinct chunks of each language, and how often each is parsed."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parsed = source.mapInArrow(_parse, "lang string, chunk string, last boolean, n long")
    return parsed.groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


def _hash_filter(h: DataFrame) -> np.ndarray:
    """Two bits for each hash in FILTER_WORDS longs: at most FILTER_WORDS rows reach the driver, however many hashes there are."""
    size = FILTER_WORDS * 64
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1)))).alias("bit")
    words = h.select(bit).groupBy(F.shiftright("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("v"))
    table = np.zeros(FILTER_WORDS, np.uint64)
    found = words.toPandas()
    table[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64).view(np.uint64)
    return table


def _in_filter(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    bits, one, low = np.uint64(FILTER_WORDS * 64 - 1), np.uint64(1), np.uint64(63)
    a, b = h & bits, (h >> np.uint64(32)) & bits
    return ((table[(a >> np.uint64(6)).astype(np.int64)] >> (a & low)) & (table[(b >> np.uint64(6)).astype(np.int64)] >> (b & low)) & one) == 1


def _halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most COUNT_BYTES, or of one longer row."""
    if batch.num_rows < 2 or batch.nbytes <= COUNT_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halved(batch.slice(0, half))
    yield from _halved(batch.slice(half))


def _larger(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined, or cut between rows, to about COUNT_BYTES, none of them empty."""
    held, size = [], 0
    for batch in batches:
        for part in _halved(batch):
            if part.num_rows:
                held.append(part)
                size += part.nbytes
            if size >= COUNT_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


class _Words:
    """Texts of a batch as one run of words: their hashes, in which text they are, and where texts start and end."""

    def __init__(self, batch: pa.RecordBatch, column: str, hashes: Hashes):
        lists = pc.split_pattern(batch[column].cast(pa.string()), " ")
        self.words = lists.flatten()
        bounds = lists.offsets.to_numpy().astype(np.int64)
        self.starts, self.ends = bounds[:-1], bounds[1:]
        self.text = np.repeat(np.arange(len(self.starts)), self.ends - self.starts)
        self.lang, self.n = batch["lang"], batch["n"].to_numpy()
        word, lang = self.words.dictionary_encode(), self.lang.dictionary_encode()
        salt = hashes.of([b"\0" + x for x in as_bytes(lang.dictionary)])[lang.indices.to_numpy()]
        # A word of another language is another word.
        self.h = mix64(hashes.of(as_bytes(word.dictionary))[word.indices.to_numpy()] + salt[self.text])

    def within(self, size: int) -> np.ndarray:
        """Whether the ``size`` words from each one on are of one text."""
        return self.text[size - 1 :] == self.text[: max(len(self.text) - size + 1, 0)]

    def joined(self, first: np.ndarray, end: np.ndarray) -> pa.Array:
        """The words from each of ``first`` to before its ``end``, as texts."""
        offsets = np.concatenate([[0], np.cumsum(end - first)])
        at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], end - first)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.words.take(pa.array(at, pa.int64()))), " ")


def _counted(c: _Words, batch: pa.RecordBatch) -> np.ndarray:
    """Where n-grams of each chunk that count here have to start before: those in the overlap count in the next chunk."""
    return c.ends - np.where(batch["last"].to_numpy(zero_copy_only=False), 0, OVERLAP)


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        salt = hashes.of([b"\0" + x.encode() for x in batch["lang"].to_pylist()])
        h = mix64(hashes.of(as_bytes(batch["phrase"])) + salt)
        yield pa.RecordBatch.from_arrays([batch["lang"], batch["phrase"], pa.array(h.view(np.int64))], names=["lang", "word", "h"])


def _pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = np.empty(2 * batch.num_rows, np.uint64)
        both[0::2], both[1::2] = (batch[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        yield pa.RecordBatch.from_arrays([pa.array(combined(both, 2)[0::2].view(np.int64))], names=["h"])


def _pair_counts(frequent):
    """Counts of the pairs of frequent words by the words' hashes, summed over about PAIR_ROWS of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, held, size = Hashes(), frequent.value, [], 0

        def told() -> Iterator[pa.RecordBatch]:
            pair, first, second, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(pair)
            pair = pair[order]
            new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]) if len(pair) else pair)
            total, at = np.add.reduceat(n[order], new) if len(new) else n, order[new]
            return _cut([pa.RecordBatch.from_arrays([pa.array(first[at].view(np.int64)), pa.array(second[at].view(np.int64)), pa.array(total)], names=["h1", "h2", "n"])], OUT_ROWS)

        for batch in _larger(batches):
            c = _Words(batch, "chunk", hashes)
            known, own = _in_filter(table, c.h), np.arange(len(c.h)) < _counted(c, batch)[c.text]
            keep = np.flatnonzero(c.within(2) & known[1:] & known[:-1] & own[:-1])
            held.append((combined(c.h, 2)[keep], c.h[keep], c.h[keep + 1], c.n[c.text[keep]]))
            size += len(keep)
            if size >= PAIR_ROWS:
                yield from told()
                size = 0
        if held:
            yield from told()

    return run


#: Words of the shortest run.
SHORTEST = 3


def _runs(frequent):
    """(lang, words, starts, n): the runs of SHORTEST words and more all of whose pairs are in the filter. Phrases begin at
    the first ``starts`` of its words; what the next chunk counts is left to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = Hashes(), frequent.value
        for batch in _larger(batches):
            c = _Words(batch, "chunk", hashes)
            good = np.concatenate([[False], c.within(2) & _in_filter(table, combined(c.h, 2)), [False]]).astype(np.int8)
            first, stop = np.flatnonzero(np.diff(good) == 1), np.flatnonzero(np.diff(good) == -1)  # words first to stop
            text = c.text[first]
            last = np.minimum(stop - SHORTEST + 1, _counted(c, batch)[text] - 1)
            keep = last >= first
            first, stop, text, last = first[keep], stop[keep], text[keep], last[keep]
            words = c.joined(first, np.minimum(stop, last + LONGEST - 1) + 1)
            told = pa.RecordBatch.from_arrays([c.lang.take(pa.array(text)), words, pa.array(last - first + 1, pa.int32()), pa.array(c.n[text])], names=["lang", "words", "starts", "n"])
            yield from _cut([told], OUT_ROWS)

    return run


def _starting(c: _Words, batch: pa.RecordBatch) -> np.ndarray:
    """Whether phrases of a run begin at a word."""
    return np.arange(len(c.h)) < (c.starts + batch["starts"].to_numpy())[c.text]


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, n): the hash of each triple of a run."""
    hashes = Hashes()
    for batch in _larger(batches):
        c = _Words(batch, "words", hashes)
        keep = np.flatnonzero(_starting(c, batch))
        told = pa.RecordBatch.from_arrays([pa.array(combined(c.h, SHORTEST)[keep].view(np.int64)), pa.array(c.n[c.text[keep]])], names=["h", "n"])
        yield from _cut([told], OUT_ROWS)


def _phrases(frequent):
    """(lang, phrase, size, n): the phrases of SHORTEST words and more of a run all of whose triples are in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = Hashes(), frequent.value
        for batch in _larger(batches):
            c = _Words(batch, "words", hashes)
            triple = c.within(SHORTEST) & _in_filter(table, combined(c.h, SHORTEST))
            good, own = triple, _starting(c, batch)
            for size in range(SHORTEST, LONGEST + 1):
                at = np.flatnonzero(good & own[: len(good)])
                told = pa.RecordBatch.from_arrays([c.lang.take(pa.array(c.text[at])), c.joined(at, at + size), pa.array(np.full(len(at), size, np.int32)), pa.array(c.n[c.text[at]])], names=["lang", "phrase", "size", "n"])
                yield from _cut([told], OUT_ROWS)
                good = good[:-1] & triple[size - SHORTEST + 1 :]

    return run


def long_phrases(entries: DataFrame, pairs, least: int) -> DataFrame:
    """(lang, phrase, size, n) of the phrases of SHORTEST words and more that may occur ``least`` times, a row for each
    distinct run that has one: none that does occur so often is missing."""
    runs = entries.select("lang", "chunk", "last", "n").mapInArrow(_runs(pairs), "lang string, words string, starts int, n long")
    runs = written(runs.groupBy("lang", "words", "starts").agg(F.sum("n").alias("n")), "runs")
    triples = runs.mapInArrow(_triples, "h long, n long").groupBy("h").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    table = entries.sparkSession.sparkContext.broadcast(_hash_filter(triples.select("h")))
    return runs.mapInArrow(_phrases(table), "lang string, phrase string, size int, n long")


def phrase_counts(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, a) of the phrases of one to LONGEST words that occur ``least`` times or more, and (lang, n)."""
    spark: SparkSession = docs.sparkSession
    path = shared_path(spark, "chunks")
    dictionary(docs).write.option("compression", "zstd").parquet(path)
    entries = spark.read.schema("lang string, chunk string, last boolean, n long").parquet(path)
    words = F.split("chunk", " ", -1)
    own = F.when(F.col("last"), words).otherwise(F.slice(words, F.lit(1), F.size(words) - OVERLAP))
    counted = entries.select("lang", "n", F.explode(own).alias("phrase")).groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
    counted = written(counted, "words")
    totals = counted.groupBy("lang").agg(F.sum("a").alias("n"))
    one = counted.filter(F.col("a") >= least)
    hashed = written(one.select("lang", "phrase").mapInArrow(_word_hashes, "lang string, word string, h long"), "word-hashes")
    table = spark.sparkContext.broadcast(_hash_filter(hashed.select("h")))
    pairs = entries.select("lang", "chunk", "last", "n").mapInArrow(_pair_counts(table), "h1 long, h2 long, n long")
    pairs = written(pairs.groupBy("h1", "h2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least), "pairs")
    both = spark.sparkContext.broadcast(_hash_filter(pairs.mapInArrow(_pair_hashes, "h long")))
    second = hashed.select(F.col("h").alias("h2"), F.col("word").alias("second"))
    two = pairs.join(hashed.withColumnRenamed("h", "h1"), "h1").join(second, "h2").select("lang", F.concat_ws(" ", "word", "second").alias("phrase"), F.lit(2).alias("size"), "a")
    more = long_phrases(entries, both, least).groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    counts = one.select("lang", "phrase", F.lit(1).alias("size"), "a").unionByName(two).unionByName(more)
    return written(counts, "phrases"), written(totals, "totals")


def _sub(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, least: int = 100, covered: int = 100, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``n`` counts a language's words, ``a`` the phrase's occurrences within pieces, ``l`` and ``r`` those of its two
    parts at the cut that scores least, the first at a tie; score is floor(1000 * a * n / (l * r)). A phrase whose words
    lie inside a longer one with 100 * f(longer) >= ``covered`` * a is left out. Null languages are "und"; null and empty
    texts, and those of marks alone, have no words. Repeated rows count as often as they are there. Equal scores go by
    ``a``, then by the phrase's bytes. Texts of any length are parsed whole, and a piece without marks or triggers is one
    chunk. Other columns are not looked at. An empty table gives no rows.

    Counts and scores are in decimals of 38 digits: 1000 * a * n may take as many, for 10**17 words.
    """
    counts, totals = phrase_counts(docs, least)
    words = F.split("phrase", " ", -1)
    size = F.col("size")
    candidates = counts.filter(size > 1)
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _sub(words, F.lit(1), F.col("k")).alias("left"), _sub(words, F.col("k") + 1, size - F.col("k")).alias("right"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    scored = attach(scored, totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("n")), exact("l") * exact("r"))
    best = scored.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("m"))
    inner = F.explode(F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(1, size - w + 1), s -> array_join(slice(words, s, w), ' '))))"))
    longer = candidates.filter(size > 2).withColumn("words", words).select("lang", F.col("a").alias("f"), inner.alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(100 * F.col("f") >= covered * F.col("a"), F.lit(False)))
    kept = kept.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), "n", F.col("m.score").alias("score"))
    ranked = kept.withColumn("rank", F.expr("row_number() over (partition by lang order by score desc, a desc, phrase)"))
    return ranked.filter(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
