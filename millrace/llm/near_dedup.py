"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct word shingles. Documents with equal sets form one class, and classes are what is
compared. Each class has a signature of the low bits of its minima, packed, and a hash for each band of whole minima.
A band's bucket is never paired off by a join: its members meet the bucket's pivot, the member that shares most
buckets with others. Pairs whose similarity, estimated from the bits and corrected for chance agreement, is far below
the threshold are dropped; the rest are confirmed on full sets.

Where members of a bucket are then still in different components, the bucket is cut into blocks of bounded size, and
each two blocks meet in one task. There signatures are compared in numpy, and sets where the estimate is near. A pair
is looked at in the first band that it shares only, and not at all once its components are joined, so that what leaves
a task are links that join components: never more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, delete, mix64, multipliers, row_key, stored, words_of, written

MINIMA, BITS = 196, 4
#: Share of pairs at the threshold that may have no band in common.
MISS = 1e-4
#: How far below the threshold an estimate still counts. Of 196 minima at similarity 0.8 its standard error is below
#: 0.032, so a true link is lost in one of a million cases or fewer.
MARGIN = 0.17
#: Rows of a hot key that go to one task, and members and shingles of a block on average.
SPREAD, BLOCK, BLOCK_SHINGLES = 2_000, 1_024, 1 << 20
_A = (multipliers(MINIMA, 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = multipliers(MINIMA, 13)
_SHINGLE = multipliers(16, 17)
_PREPARED = "doc long, row long, n long, fp binary, signature binary, bands array<long>"


def banding(least: float) -> tuple[int, int]:
    """Number of bands and minima in each: the longest bands that lose at most MISS of pairs at the threshold."""
    rows = max(r for r in range(1, MINIMA + 1) if r == 1 or (1 - least**r) ** (MINIMA // r) <= MISS)
    return MINIMA // rows, rows


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``k`` words; of the whole sequence if it is shorter; none of nothing."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    h = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        h = h + words[i : n - size + 1 + i] * _SHINGLE[i]
    return np.unique(mix64(h))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of MINIMA orders of a set's shingles, as spread 64-bit values."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(MINIMA, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(short), 512):
        x = short[None, a : a + 512] * _A[:, None]
        x ^= x >> np.uint32(15)
        np.minimum(out, x.min(axis=1), out=out)
    return mix64(out.astype(np.uint64) + np.uint64(1))


def pack(mins: np.ndarray) -> bytes:
    low = (mins & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] << 4 | low[1::2]).tobytes()


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of packed signatures: equal low bits, less those equal by chance."""
    x = a ^ b
    equal = np.count_nonzero(x < 16, axis=1) + np.count_nonzero((x & 15) == 0, axis=1)
    chance = 1 / (1 << BITS)
    return (equal / MINIMA - chance) / (1 - chance)


def _prepare(k: int, least: float):
    n_bands, rows = banding(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, fps, sigs, bands = [], [], [], []
            for text in as_bytes(batch["text"]):
                s = shingle_set(hashes.of(words_of(text)), k)
                sizes.append(len(s))
                if not len(s):
                    fps.append(None), sigs.append(None), bands.append(None)
                    continue
                m = minima(s)
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(pack(m))
                h = np.zeros(n_bands, np.uint64)
                for r in range(rows):
                    h = (h + m[: n_bands * rows].reshape(n_bands, rows)[:, r]) * _B[:n_bands]
                bands.append(mix64(h + np.arange(n_bands, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc"], batch["row"], pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc", "row", "n", "fp", "signature", "bands"],
            )

    return run


def _screen(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, MINIMA // 2) for c in ("sa", "sb"))
            na, nb = (batch[c].to_numpy() for c in ("na", "nb"))
            near = (agreement(a, b) >= least - MARGIN) & (np.minimum(na, nb) >= least * np.maximum(na, nb) - 1e-9)
            yield batch.select(["a", "b", "salt"]).filter(pa.array(near))

    return run


def linked(a: np.ndarray, b: np.ndarray, over: int, under: int) -> bool:
    """Whether two sorted sets are at least ``over / under`` alike."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return under * n >= over * (len(a) + len(b) - n)


def _confirm(k: int, over: int, under: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, last_set = WordHashes(), None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch["a"].to_pylist(), as_bytes(batch["ta"]), as_bytes(batch["tb"]), strict=True):
                if a != last:
                    last, last_set = a, shingle_set(hashes.of(words_of(ta)), k)
                keep.append(linked(last_set, shingle_set(hashes.of(words_of(tb)), k), over, under))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each component of an edge list, by alternating large and small stars.

    A large star ties each node's larger neighbours to its least one; a small star ties its smaller neighbours and
    itself to its least one. Both only take a minimum by node and join it back, so a node with a third of all edges
    is summed up where its edges are and its join can be split. A round's edges are deleted once the next ones are
    written.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).filter("lo != hi").distinct(), "stars")
    state = None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).filter("lo != hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        tied = large.join(least, "hi")
        small = tied.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(tied.select(F.col("m").alias("lo"), "hi"))
        before = path
        now, path = stored(small.filter("lo != hi").distinct(), "stars")
        delete(spark, before)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("label"))


def _salt(rows: Column, width: Column) -> Column:
    """One of ``width`` parts of a hot key's rows."""
    return F.pmod(F.xxhash64(rows), width)


def _parts(width: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), width - 1))


def _width(rows: str) -> Column:
    return F.ceil(F.col(rows) / SPREAD).cast("long")


def _links(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, over: int, under: int) -> DataFrame:
    """The pairs (a, b, salt) that are linked: screened on signatures, confirmed on full sets.

    A class ``a`` that meets many others is copied once for each salt, so that its pairs are dealt to several tasks.
    """

    def joined(pairs: DataFrame, side: DataFrame, names: dict[str, str]) -> DataFrame:
        ours = side.withColumnsRenamed({"fp": "b"} | {x: f"{y}b" for x, y in names.items()})
        theirs = side.withColumnsRenamed({"fp": "a"} | {x: f"{y}a" for x, y in names.items()})
        heads = pairs.select("a", "salt").distinct().join(theirs, "a")
        return pairs.join(ours, "b").join(heads, ["a", "salt"]).select("a", "b", "salt", *(f"{y}{e}" for y in names.values() for e in "ab"))

    near = joined(pairs, classes.select("fp", "signature", "n"), {"signature": "s", "n": "n"}).mapInArrow(_screen(over / under), "a binary, b binary, salt long")
    near = written(near, "near")
    full = joined(near, texts, {"text": "t"})
    return written(full.select("a", "b", "ta", "tb").mapInArrow(_confirm(k, over, under), "a binary, b binary"), "links")


def _pivot_pairs(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, salt) of each bucket's pivot and its other members, and the members without the pivots."""
    best = member.groupBy("bucket").agg(F.max(F.struct("score", "fp")).alias("p"), F.max("size").alias("size"))
    best = best.select("bucket", F.col("p.fp").alias("a"), "size")
    widest = best.groupBy("a").agg(F.max("size").alias("widest"))  # a class has one bucket a band at most
    best = best.join(widest, "a").select("bucket", "a", "widest", _parts(_width("size")).alias("part"))
    met = member.withColumn("part", _salt(F.col("fp"), _width("size"))).join(best, ["bucket", "part"]).filter(F.col("fp") != F.col("a"))
    met = written(met.select("bucket", "band", "fp", "n", "size", "a", "widest"), "met")
    pairs = met.select("a", F.col("fp").alias("b"), _salt(F.col("fp"), _width("widest")).alias("salt")).distinct()
    return pairs, met.select("bucket", "band", "fp", "n", "size")


def _open_members(member: DataFrame, label_of: DataFrame) -> DataFrame:
    """(bucket, band, fp, label, blocks) of members of buckets whose members are in different components."""
    labelled = written(member.join(label_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labelled")
    by_label = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"), F.max("size").alias("size"))
    open_ = by_label.groupBy("bucket").agg(F.count(F.lit(1)).alias("labels"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.max("size").alias("size")).filter("labels > 1")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("long").alias("blocks")
    open_ = open_.select("bucket", blocks, _parts(_width("size")).alias("part"))
    return labelled.withColumn("part", _salt(F.col("fp"), _width("size"))).join(open_, ["bucket", "part"]).select("bucket", "band", "fp", "label", "blocks")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(hashes.of(words_of(t)), k).tobytes() for t in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["fp"], pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["fp", "shingles"])

    return run


def block_links(fps: list, labels: list, mine: list, band: int, signatures: list, bands: list, sets: list, over: int, under: int) -> list[tuple]:
    """Links that join components among the members of two blocks (or one, if ``mine`` is all alike)."""
    _, root = np.unique(np.array(labels, object), return_inverse=True)
    if len(set(root.tolist())) < 2:
        return []
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, root, side = sizes[order], root[order], np.array(mine)[order]
    sig = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(sets), -1)[order]
    keys = np.array(bands, np.int64)[order][:, :band]
    one = len(set(mine)) == 1
    lows = np.searchsorted(under * sizes, over * sizes)
    out = []
    for p in range(1, len(order)):
        c = np.arange(lows[p], p)
        c = c[(root[c] != root[p]) & (one | (side[c] != side[p]))]
        if not len(c):
            continue
        like = agreement(sig[c], sig[p])
        near = like >= over / under - MARGIN
        c, like = c[near], like[near]
        if band and len(c):
            new = ~(keys[c] == keys[p]).any(axis=1)
            c, like = c[new], like[new]
        for q in c[np.argsort(-like, kind="stable")]:
            if root[q] != root[p] and linked(sets[order[p]], sets[order[q]], over, under):
                root[root == root[q]] = root[p]
                out.append((fps[order[p]], fps[order[q]]))
    return out


def _blocks(over: int, under: int):
    """A stream of rows sorted by bucket and pair of blocks; one such pair is in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def found() -> pa.RecordBatch:
            links = []
            if rows:
                fps, labels, mine, band, sig, bands, sets = zip(*rows, strict=True)
                links = block_links(list(fps), list(labels), list(mine), band[0], list(sig), list(bands), list(sets), over, under)
            a, b = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch["shingles"].to_pylist()]
            bands = [x.values.to_numpy() for x in batch["bands"]]
            columns = [batch[c].to_pylist() for c in ("bucket", "i", "j", "fp", "label", "mine", "band", "signature")]
            for bucket, i, j, fp, label, mine, band, sig, band_keys, s in zip(*columns, bands, sets, strict=True):
                if (bucket, i, j) != key:
                    yield found()
                    key, rows = (bucket, i, j), []
                rows.append((fp, label, mine, band, sig, band_keys, s))
        yield found()

    return run


def _within(members: DataFrame, classes: DataFrame, texts: DataFrame, k: int, over: int, under: int) -> DataFrame:
    """The links (a, b) that join components inside buckets: each two blocks of a bucket meet in one task."""
    sets = texts.join(members.select("fp").distinct(), "fp").select("fp", "text").mapInArrow(_sets(k), "fp binary, shingles binary")
    sets = written(sets.join(classes.select("fp", "signature", "bands"), "fp"), "open-sets")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks"))
    each = members.withColumn("mine", mine).withColumn("other", _parts(F.col("blocks")))
    each = each.select("bucket", "band", "fp", "label", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    placed = each.join(sets, "fp").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return written(placed.mapInArrow(_blocks(over, under), "a binary, b binary"), "block-links")


def near_duplicates(docs: DataFrame, words: int = 5, over: int = 80, under: int = 100) -> DataFrame:
    """One row per document: doc_id, row, n_shingles, component_id, keeper.

    Linked are documents with ``under * intersection >= over * union``. component_id is the least doc_id reachable, a
    null id the last; keeper is (doc_id, row) of the document to keep, so that one of several rows with the least id
    can be told. Null, empty and blank texts have no shingles and stand alone. Repeated rows share ``row``, and ties
    in doc_id are broken by it. Texts of any length are taken whole. Other columns are not looked at. An empty table
    gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    prepared = written(source.mapInArrow(_prepare(words, over / under), _PREPARED), "minhash")
    first = F.struct(F.isnull("doc").alias("none"), F.col("doc"), F.col("row"))
    slim = prepared.filter("n > 0").groupBy("fp").agg(F.min(first).alias("head"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    classes = written(slim, "classes")

    member = classes.select("fp", "n", F.posexplode("bands").alias("band", "bucket"))
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = written(member.join(sizes, "bucket"), "buckets")
    score = member.groupBy("fp").agg(F.sum("size").alias("score"))
    wanted = classes.join(score.select("fp"), "fp", "left_semi").select("fp", "row")
    texts = written(source.select("row", "text").dropDuplicates(["row"]).join(wanted, "row").select("fp", "text"), "texts")

    pairs, rest = _pivot_pairs(member.join(score, "fp"))
    links = _links(pairs, classes, texts, words, over, under)
    label_of = components(links)
    open_ = written(_open_members(rest, label_of), "open-members")
    if not open_.isEmpty():
        more = _within(open_, classes, texts, words, over, under)
        if not more.isEmpty():
            label_of = components(label_of.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    of_class = classes.select("fp", "head").join(label_of.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = of_class.groupBy("label").agg(F.min("head").alias("keeper"))
    of_class = written(of_class.select("fp", "label").join(heads, "label").select("fp", "keeper"), "class-heads")
    out = prepared.select("doc", "row", "n", "fp").join(of_class, "fp", "left")
    keeper = F.coalesce(F.col("keeper"), F.struct(F.isnull("doc").alias("none"), F.col("doc"), F.col("row")))
    return out.select(F.col("doc").alias("doc_id"), "row", F.col("n").alias("n_shingles"), keeper["doc"].alias("component_id"), keeper.alias("keeper"))
