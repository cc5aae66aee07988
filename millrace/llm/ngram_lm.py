"""Language-model scoring with Elias-Fano n-gram tries of order three, one for each shard of the n-grams.

The model grows with the corpus, so no task and no driver holds all of it. One pass over the documents numbers the
words of each batch of them; the numbered batches are a table a third as large as the texts. From a batch come its
distinct words, pairs and triples as a small tree for each shard, the most compact form in which they can be shuffled.
One shuffle brings a shard's trees together: they are summed into the shard's trie, which is stored, and their n-grams
are what is then looked up in it. A second shuffle brings the answers to the batches, where documents are scored.

An n-gram's shard follows from its first word, and for the few thousand words that make up most of the corpus from
the words after it too, within a share of the shards that doesn't shrink as their number grows, so that a frequent word
or pair of words is spread over many. An n-gram is in a batch's trees once however often it occurs there. Triples that
occur once only are left out of the tries.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, as_bytes, concat, crc_mod, mix64, words_of, written

#: Tokens of a batch, if its last document doesn't go beyond, and tokens to a shard on average.
BATCH_TOKENS, SHARD_TOKENS = 800_000, 1_500_000
#: A word is frequent if it makes up one in FREQUENT tokens; there are at most twice as many such words, whatever the
#: corpus. The pairs of one are spread over one in SPREAD shards, and so are the triples of each pair; those of another
#: word over as many as keep a shard's load within a few times the average.
FREQUENT, SPREAD = 4096, 8
#: Triples that occur less often are left out.
LEAST_TRIPLES = 2
#: Pseudo-counts of the shorter context in every pair's and every triple's (Dirichlet smoothing); held-out texts are
#: likelier so than with 50 for both.
PRIOR, TRIPLE_PRIOR = 300.0, 30.0
#: Counts up to here have a code each; larger ones share those that are left, in equal steps of their logarithm up to
#: the largest count of the shard.
EXACT = 128
END = np.uint64(0x5EED0E0D)
START = np.uint64(0x5EED57A7)
_CODEC = pa.Codec("zstd", compression_level=1)
#: Second words go as the upper 32 bits of their hash, third ones, of which a pair has few, as the lower 24.
_LOW, _LOWER = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFF)


def levels(top: int) -> np.ndarray:
    """The counts that the 256 codes stand for, if ``top`` is the largest."""
    steps = np.arange(1, 256 - EXACT) / (255 - EXACT)
    return np.r_[np.arange(EXACT + 1), EXACT * (max(top, EXACT) / EXACT) ** steps]


def quantise(count: np.ndarray, top: int) -> np.ndarray:
    """Codes of counts: joint probabilities of n-grams but for the division by all tokens."""
    with np.errstate(divide="ignore", invalid="ignore"):
        high = EXACT + np.rint((255 - EXACT) * np.log(count / EXACT) / np.log(max(top, EXACT + 1) / EXACT))
    return np.where(count <= EXACT, count, high).astype(np.uint8)


class EliasFano:
    """A sorted sequence in one memory map: whole low bytes of each value, and the high parts in unary."""

    def __init__(self, values: np.ndarray, universe: int):
        values = values.astype(np.uint64)
        n = len(values)
        bits = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        self.n, self.low_bytes = n, min(7, -(-bits // 8))
        parts = (values >> np.uint64(8 * self.low_bytes)).astype(np.int64)
        ones = np.zeros(n + (int(parts[-1]) if n else 0) + 1, np.uint8)
        ones[parts + np.arange(n)] = 1
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, : self.low_bytes])
        self._map(low.tobytes() + np.packbits(ones).tobytes())

    def _map(self, data: bytes) -> None:
        self.map = mmap.mmap(-1, max(len(data), 1))
        self.map[: len(data)] = data
        self.low = np.frombuffer(self.map, np.uint8, self.n * self.low_bytes).reshape(self.n, self.low_bytes)
        self.high = np.frombuffer(self.map, np.uint8, offset=self.n * self.low_bytes)
        self.ones: np.ndarray | None = None  # where the unary part has its ones, found when first asked

    def stored(self) -> bytes:
        return self.n.to_bytes(8, "little") + bytes([self.low_bytes]) + self.map[:]

    @classmethod
    def opened(cls, data: bytes) -> EliasFano:
        new = cls.__new__(cls)
        new.n, new.low_bytes = int.from_bytes(data[:8], "little"), data[8]
        new._map(data[9:])
        return new

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        if self.ones is None:
            self.ones = np.flatnonzero(np.unpackbits(self.high)[: self.n + len(self.high) * 8])[: self.n]
        low = np.zeros((len(i), 8), np.uint8)
        low[:, : self.low_bytes] = self.low[i]
        return ((self.ones[i] - i).astype(np.uint64) << np.uint64(8 * self.low_bytes)) | low.view("<u8").ravel()

    def successor(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each key the first place from ``begin`` on, ``end`` at most, whose value isn't below it, and whether it is the key."""
        lo, hi = begin.astype(np.int64), end.astype(np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.get(mid) < keys[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        hit = lo < end
        hit[hit] = self.get(lo[hit]) == keys[hit]
        return lo, hit


@dataclass
class Trie:
    """Words, the pairs that each begins and the triples that each pair begins, with their counts.

    Levels are monotone: words by hash, pointers by nature, and successors because each context's are moved up by the
    context's place. A search for one goes from its context's pointer to the next context's only.
    """

    words: EliasFano
    word_n: np.ndarray
    to_pairs: EliasFano
    pairs: EliasFano
    pair_codes: np.ndarray
    to_triples: EliasFano
    triples: EliasFano
    triple_codes: np.ndarray
    top: int

    @classmethod
    def built(cls, words, word_n, pairs, pair_n, triples, triple_n) -> Trie:
        """From sorted words; pairs as place of the word << 32 | second; triples as place of the pair << 32 | third."""
        below = lambda owner, n: np.r_[0, np.cumsum(np.bincount(owner.astype(np.int64), minlength=n))]
        a, b = below(pairs >> np.uint64(32), len(words)), below(triples >> np.uint64(32), len(pairs))
        top = int(max(pair_n.max(initial=0), triple_n.max(initial=0)))
        return cls(
            EliasFano(words, 1 << 64), word_n, EliasFano(a, int(a[-1]) + 1), EliasFano(pairs, max(len(words), 1) << 32), quantise(pair_n, top),
            EliasFano(b, int(b[-1]) + 1), EliasFano(triples, max(len(pairs), 1) << 32), quantise(triple_n, top), top,
        )

    def word(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and count of words, and whether they are known."""
        place, known = self.words.successor(words, np.zeros(len(words), np.int64), np.full(len(words), self.words.n))
        count = np.zeros(len(words), np.int64)
        count[known] = self.word_n[place[known]]
        return place, count, known

    @staticmethod
    def _next(pointers: EliasFano, level: EliasFano, codes: np.ndarray, context: np.ndarray, known: np.ndarray, last: np.ndarray):
        place, code, hit = np.zeros(len(last), np.int64), np.zeros(len(last), np.uint8), np.zeros(len(last), bool)
        c = context[known]
        at, found = level.successor((c.astype(np.uint64) << np.uint64(32)) | last[known].astype(np.uint64), pointers.get(c).astype(np.int64), pointers.get(c + 1).astype(np.int64))
        place[known], hit[known] = at, found
        code[hit] = codes[place[hit]]
        return place, code, hit

    def pair(self, word: np.ndarray, known: np.ndarray, second: np.ndarray):
        """Place and code of the pairs of words at ``word`` and ``second``, and whether they are known."""
        return self._next(self.to_pairs, self.pairs, self.pair_codes, word, known, second)

    def triple(self, pair: np.ndarray, known: np.ndarray, third: np.ndarray):
        return self._next(self.to_triples, self.triples, self.triple_codes, pair, known, third)

    def stored(self) -> dict[str, bytes]:
        found = {n: getattr(self, n).stored() for n in ("words", "to_pairs", "pairs", "to_triples", "triples")}
        return found | {"word_n": _pack(self.word_n, "<u8"), "pair_codes": self.pair_codes.tobytes(), "triple_codes": self.triple_codes.tobytes()}

    @classmethod
    def opened(cls, row: dict) -> Trie:
        level = lambda name: EliasFano.opened(row[name])
        codes = lambda name: np.frombuffer(row[name], np.uint8)
        return cls(level("words"), _unpack(row["word_n"], "<u8"), level("to_pairs"), level("pairs"), codes("pair_codes"), level("to_triples"), level("triples"), codes("triple_codes"), row["top"])


def _squeeze(raw: bytes) -> bytes:
    """Bytes compressed, their number before them."""
    return len(raw).to_bytes(8, "little") + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def _swell(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return _CODEC.decompress(data[8:], size, asbytes=True) if size else b""


def _pack(a: np.ndarray, kind: str = "<u4") -> bytes:
    """Numbers, compressed byte plane by byte plane."""
    planes = np.ascontiguousarray(a.astype(kind)).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    return _squeeze(planes.tobytes())


def _planes(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(_swell(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _unpack(data: bytes, kind: str = "<u4") -> np.ndarray:
    return _planes(data, kind).astype(np.int64)


def _pack_steps(a: np.ndarray, kind: str) -> bytes:
    """Numbers that mostly ascend, by their differences."""
    a = a.astype(kind)
    return _pack(np.diff(a, prepend=a.dtype.type(0)), kind)


def _unpack_steps(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_planes(data, kind), dtype=kind)


def _rows(schema: str, **columns) -> pa.RecordBatch:
    """A batch of the columns given, the others null."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.split() for x in schema.split(", ")]
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * size), kinds[t]) for n, t in fields], names=[n for n, _ in fields])


_BATCHES = "batch string, doc_id array<long>, held array<boolean>, tokens long, sizes binary, names binary, ids binary"


def _number(most: int):
    """Batches of documents as numbers of their distinct words, frequent words first, which take fewer bytes."""
    return lambda batches: _numbered(batches, most)


def _numbered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    hashes, k = WordHashes(keep=1 << 18), 0
    ids, held, docs, total, part = [], [], [], 0, 0

    def done() -> pa.RecordBatch:
        names, at, n = np.unique(np.concatenate([*docs, [START]]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        names, at = names[order], rank[at]
        sizes = np.array([len(d) for d in docs])
        return _rows(_BATCHES, batch=[f"{part}-{k}"], doc_id=[ids], held=[held], tokens=[int(sizes.sum())], sizes=[_pack(sizes)], names=[_pack_steps(names, "<u8")], ids=[_pack(at[:-1])])

    for batch in batches:
        part = batch["part"][0].as_py() if batch.num_rows else part
        for doc, out, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), as_bytes(batch["text"]), strict=True):
            tokens = np.append(hashes.of(words_of(text)), END)
            ids.append(doc), held.append(out), docs.append(tokens)
            total += len(tokens)
            if total >= most:
                yield done()
                ids, held, docs, total, k = [], [], [], 0, k + 1
    if docs:
        yield done()


def _each(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one in memory at a time."""
    return (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of words that make up one in 2 * FREQUENT tokens of a batch: at most as many rows of each."""
    for batch in batches:
        for row in _each(batch):
            n = np.bincount(_unpack(row["ids"]))
            some = np.flatnonzero(n * 2 * FREQUENT >= row["tokens"])
            words = _unpack_steps(row["names"], "<u8")[some].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n[some])], names=["word", "n"])


def frequent_words(batches: DataFrame, tokens: int) -> np.ndarray:
    """Sorted words that make up one in FREQUENT tokens, and maybe some that make up half of that."""
    counted = batches.select("tokens", "names", "ids").mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # Batches in which such a word is rarer than they report lack half of its tokens at most.
    found = counted.filter(F.col("n") * 2 * FREQUENT >= tokens).select("word").toArrow()
    return np.sort(found["word"].to_numpy().view(np.uint64))


class Grams:
    """A batch's words, pairs and triples in the order in which its trees hold them, shard by shard."""

    def __init__(self, row: dict, shards: int, frequent: np.ndarray):
        names = _unpack_steps(row["names"], "<u8")
        order = np.argsort(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        self.names = names = names[order]
        self.ids = ids = rank[_unpack(row["ids"])]
        self.sizes = _unpack(row["sizes"])
        self.starts = starts = np.cumsum(np.r_[0, self.sizes])[:-1]
        start = int(np.searchsorted(names, START))
        before = np.r_[start, ids[:-1]]
        before[starts] = start
        pairs, pair = np.unique(np.r_[before << 32 | ids, start << 32 | start], return_inverse=True)
        self.pair, first_context = pair[:-1], pair[-1]
        before = np.r_[first_context, self.pair[:-1]]
        before[starts] = first_context
        before <<= 32
        before |= ids
        triples, triple = np.unique(before, return_inverse=True)
        del before, pair
        i, j, c, w = pairs >> 32, pairs & 0xFFFFFFFF, triples >> 32, triples & 0xFFFFFFFF

        hash_ = mix64(names)
        own_shard, width = (hash_ % np.uint64(shards)).astype(np.int64), max(1, shards // SPREAD)
        part = ((hash_ >> np.uint64(24)) % np.uint64(width)).astype(np.int64)
        common = np.isin(names, frequent) | (names == START)
        narrow = part % -(-4 * shards // FREQUENT)  # of what is less than one in FREQUENT
        home = (own_shard[i] + np.where(common[i], part[j], narrow[j])) % shards
        p, v = len(pairs), len(names)
        here = (home[c] + np.where((common[i] & common[j])[c], part[w], narrow[w])) % shards * p + c
        nodes, node = np.unique(np.r_[here, home * p + np.arange(p)], return_inverse=True)
        of_triple, self.of_pair = node[: len(triples)], node[len(triples) :]
        shard, own = nodes // p, nodes % p
        firsts, first = np.unique(np.r_[shard * v + i[own], own_shard * v + np.arange(v)], return_inverse=True)
        self.of_word = first[len(nodes) :]
        order = np.argsort(of_triple << 32 | w)
        place = np.empty(len(triples), np.int64)
        place[order] = np.arange(len(triples))
        self.triple = place[triple]  # of each token
        self.first, self.second, self.third = names[firsts % v], (names[j[own]] >> np.uint64(32)).astype("<u4"), names[w[order]] & _LOWER
        self.under_first, self.under_second = np.bincount(first[: len(nodes)], minlength=len(firsts)), np.bincount(of_triple, minlength=len(nodes))
        ends = np.arange(shards + 1)
        self.first_cuts, self.second_cuts = np.searchsorted(firsts // v, ends), np.searchsorted(shard, ends)
        self.third_cuts = np.searchsorted(of_triple[order], self.second_cuts)

    def counts(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How often each word, pair and triple occurs among the tokens of ``train``; at an n-gram's home only."""
        n1, n2 = np.zeros(len(self.first), np.int64), np.zeros(len(self.second), np.int64)
        n1[self.of_word] = np.bincount(self.ids[train], minlength=len(self.names))
        n2[self.of_pair] = np.bincount(self.pair[train], minlength=len(self.of_pair))
        return n1, n2, np.bincount(self.triple[train], minlength=len(self.third))


_TREES = "batch string, shard int, first binary, under_first binary, second binary, under_second binary, third binary, n1 binary, n2 binary, n3 binary"


def _trees(shards: int, frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _each(batch):
                g = Grams(row, shards, frequent)
                n1, n2, n3 = g.counts(np.repeat(~np.array(row["held"], bool), g.sizes))
                rows = {n.split()[0]: [] for n in _TREES.split(", ")}
                for s in range(shards):
                    a, b, c = (slice(x[s], x[s + 1]) for x in (g.first_cuts, g.second_cuts, g.third_cuts))
                    if a.start < a.stop:
                        values = (row["batch"], s, _pack_steps(g.first[a], "<u8"), _pack(g.under_first[a]), _pack_steps(g.second[b], "<u4"), _pack(g.under_second[b]), g.third[c].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), _pack(n1[a]), _pack(n2[b]), _pack(n3[c]))
                        for column, value in zip(rows.values(), values, strict=True):
                            column.append(value)
                    if len(rows["batch"]) >= 100:
                        yield _rows(_TREES, **rows)
                        rows = {n: [] for n in rows}
                yield _rows(_TREES, **rows)

    return run


_SERVED = (
    "batch string, shard int, top long, word_n binary, pair_codes binary, triple_codes binary, tokens long, types long, "
    "words binary, to_pairs binary, pairs binary, to_triples binary, triples binary"
)


def _merged(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of each value among them, and the sums of ``n``."""
    distinct, at = np.unique(values, return_inverse=True)
    return distinct, at, np.bincount(at, n, len(distinct)).astype(np.int64)


def _serve(table: pa.Table) -> pa.Table:
    """Sum a shard's trees into a trie, store it, and answer each batch's tree from it."""
    table = table.sort_by("batch")
    sorted_ = lambda name, kind: [_unpack_steps(x, kind) for x in table[name].to_pylist()]
    small = lambda name: concat((_unpack(x) for x in table[name].to_pylist()), np.int64)
    firsts, seconds = sorted_("first", "<u8"), sorted_("second", "<u4")
    thirds = [np.pad(np.frombuffer(x, np.uint8).reshape(-1, 3), ((0, 0), (0, 1))).view("<u4").ravel() for x in table["third"].to_pylist()]
    words, word, n1 = _merged(np.concatenate(firsts), small("n1"))
    pairs, pair, n2 = _merged(np.repeat(word, small("under_first")).astype(np.uint64) << np.uint64(32) | np.concatenate(seconds), small("n2"))
    triples, triple, n3 = _merged(np.repeat(pair, small("under_second")).astype(np.uint64) << np.uint64(32) | np.concatenate(thirds), small("n3"))

    # Only what was counted enters the trie, and what it hangs on.
    high = lambda x: (x >> np.uint64(32)).astype(np.int64)
    live3 = n3 >= LEAST_TRIPLES
    live2 = n2 > 0
    live2[high(triples[live3])] = True
    live1 = n1 > 0
    live1[high(pairs[live2])] = True
    moved = lambda values, live, above: (np.cumsum(above) - 1)[high(values[live])].astype(np.uint64) << np.uint64(32) | (values[live] & _LOW)
    trie = Trie.built(words[live1], n1[live1], moved(pairs, live2, live1), n2[live2], moved(triples, live3, live2), n3[live3])

    at1, count, known1 = trie.word(words)
    at2, code2, known2 = trie.pair(at1[high(pairs)], known1[high(pairs)], pairs & _LOW)
    _, code3, _ = trie.triple(at2[high(triples)], known2[high(triples)], triples & _LOW)
    ends = lambda parts: np.r_[0, np.cumsum([len(x) for x in parts])]
    a, b, c = ends(firsts), ends(seconds), ends(thirds)
    count, code2, code3 = count[word], code2[pair], code3[triple]
    k = range(table.num_rows)
    squeeze = lambda codes, cuts: [_squeeze(codes[cuts[i] : cuts[i + 1]].tobytes()) for i in k]
    shard = table["shard"][0].as_py()
    answers = _rows(_SERVED, batch=table["batch"].to_pylist(), shard=[shard] * len(k), top=[trie.top] * len(k), word_n=[_pack(count[a[i] : a[i + 1]], "<u8") for i in k], pair_codes=squeeze(code2, b), triple_codes=squeeze(code3, c))
    model = _rows(_SERVED, shard=[shard], top=[trie.top], tokens=[int(n1.sum())], types=[int((n1 > 0).sum())], **{n: [x] for n, x in trie.stored().items()})
    return pa.Table.from_batches([answers, model])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shards: int, frequent: np.ndarray, tokens: int, types: int, documents: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        row, answers = table.slice(0, 1).to_pylist()[0], table.slice(1).to_pylist()
        g = Grams(row, shards, frequent)
        decode = lambda name: concat((levels(x["top"])[np.frombuffer(_swell(x[name]), np.uint8)] for x in answers), np.float64)
        word_n = concat((_unpack(x["word_n"], "<u8") for x in answers), np.int64)[g.of_word][g.ids]
        pair_n = decode("pair_codes")[g.of_pair][g.pair]
        triple_n = decode("triple_codes")[g.triple]

        def context(n: np.ndarray) -> np.ndarray:
            """Each token's context's count: that of the n-gram that ends before it, of the documents at a start."""
            out = np.r_[documents, n[:-1]].astype(np.float64)
            out[g.starts] = documents
            return out

        p1 = (word_n + 0.5) / (tokens + 0.5 * (types + 1))
        p2 = (pair_n + PRIOR * p1) / (context(word_n) + PRIOR)
        p3 = (triple_n + TRIPLE_PRIOR * p2) / (context(pair_n) + TRIPLE_PRIOR)
        of = lambda x: np.add.reduceat(x, g.starts)
        return pa.table({
            "doc_id": pa.array(row["doc_id"], pa.int64()), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": g.sizes, "n_known": of((word_n > 0).astype(np.int64)),
            "train_tokens": np.full(len(g.sizes), tokens, np.int64), "base_score": of(np.log10(p1)), "score": of(np.log10(p3)),
        })

    return run


def score_documents(docs: DataFrame, fold: int = 1, folds: int = 5, batch_tokens: int = BATCH_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32(doc_id as text) modulo ``folds`` isn't ``fold``. A token is a word with A-Z
    lower-cased, or the one end of a text; null and empty texts have the end only. Triples count from twice on. base_score is that of single
    tokens, score that of each token after the two before it, smoothed with pairs and those with single tokens; both
    are log10 of the text's probability. A null id counts as empty text for the fold. Repeated rows count as often and
    each get a row. Texts of any length are scored whole; a batch holds at least one. Other columns are not looked at.
    An empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), folds) == fold).alias("held"), "text", F.spark_partition_id().alias("part"))
    batches = written(source.mapInArrow(_number(batch_tokens), _BATCHES), "ngram-batches")
    size = batches.agg(F.count(F.lit(1)).alias("batches"), F.sum("tokens").alias("tokens"), F.sum(F.size(F.filter("held", lambda x: ~x))).alias("documents")).first()
    shards = max(1, -(-(size["tokens"] or 0) // shard_tokens))
    frequent = frequent_words(batches, size["tokens"] or 0)
    trees = batches.mapInArrow(_trees(shards, frequent), _TREES)
    # As many partitions as shards, and as batches below, so that what a task reads stays the same as the input grows.
    served = written(trees.repartition(shards, "shard").groupBy("shard").applyInArrow(_serve, _SERVED), "ngram-tries")
    known = served.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    answers = served.filter(F.col("batch").isNotNull()).select("batch", "shard", "top", "word_n", "pair_codes", "triple_codes")
    both = answers.unionByName(batches.withColumn("shard", F.lit(-1)), allowMissingColumns=True)
    return both.repartition(max(1, size["batches"]), "batch").groupBy("batch").applyInArrow(_score(shards, frequent, known["tokens"] or 0, known["types"] or 0, size["documents"] or 0), _SCORES)
