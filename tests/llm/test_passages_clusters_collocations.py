"""Repeated passages, centroid clusters and collocations against brute force."""

import collections
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter
from fractions import Fraction
from itertools import pairwise
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import centroid_clusters, collocations, repeated_passages
from millrace.llm.common import row_key

SCHEMA = "doc_id long, text string, lang string, bucket string, n double"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    random.seed(8)
    words = [f"w{i}" for i in range(400)]
    line = lambda n: " ".join(random.choice(words) for _ in range(n))
    shared, other = line(60), line(40)
    rows = [(1, None, None), (2, "", "en"), (3, "short", "en"), (4, line(30) + shared + line(20), "en"), (5, shared + line(9) + shared[:130], "fr"), (6, "ab" * 300, "en"), (7, line(5) + "ab" * 200 + line(5), "en")]
    rows += [(8, "é日" * 5 + shared + "\U0001f642", "de"), (9, other, None), (9, other + " more", None), (None, line(4) + other, "en"), (10, other, "en"), (10, other, "en"), (11, line(20_000) + other + line(20_000), "en")]
    rows += [(100 + i, f"{i} " + shared + f" {i}" + line(10), "en") for i in range(30)] + [(200 + i, line(50), "en") for i in range(30)]
    return rows


def passages_by_hand(spark, rows, length):
    df = table(spark, rows)
    keyed = {(r.doc_id, r.text, r.row) for r in df.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row")).collect()}
    seen, out = set(), {}
    for doc, text, _ in sorted(keyed, key=lambda r: (r[0] is None, r[0] or 0, r[2])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[doc, text] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    return sorted((doc, *out[doc, text]) for doc, text, _ in [(d, t, None) for d, t, _ in rows] if doc is not None), sorted(out[d, t] for d, t, _ in rows if d is None)


@pytest.mark.parametrize("length,large", [(100, 2048), (100, 3), (16, 2048), (13, 5)])
def test_repeated_passages(spark, texts, monkeypatch, length, large):
    """Copies, passages, periods, text in many bytes, repeated rows and ids, a long text; with buckets that are too large as well."""
    monkeypatch.setattr(repeated_passages, "BUCKET_ROWS", large)
    out = repeated_passages.drop_repeats(table(spark, texts).repartition(3), length).collect()
    flat = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in out]
    want, want_null = passages_by_hand(spark, texts, length)
    assert sorted(x for x in flat if x[0] is not None) == want and sorted(x[1:] for x in flat if x[0] is None) == want_null
    assert sum(x[2] for x in flat) > 2000


def test_repeated_passages_of_nothing(spark):
    assert repeated_passages.drop_repeats(table(spark, [])).count() == 0
    [row] = repeated_passages.drop_repeats(table(spark, [(None, None, None)]), keep_text=False).collect()
    assert (row.doc_id, row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256) == (None, 0, 0, 0, hashlib.sha256(b"").hexdigest())


def test_frequent_grams_change_nothing(spark, texts, monkeypatch):
    plain = sorted(repeated_passages.drop_repeats(table(spark, texts), keep_text=False).collect(), key=repr)
    monkeypatch.setattr(repeated_passages, "_LEAST_SEEN", 2)
    found = []
    frequent = repeated_passages._frequent
    monkeypatch.setattr(repeated_passages, "_frequent", lambda *a: found.append(frequent(*a)) or found[-1])
    assert sorted(repeated_passages.drop_repeats(table(spark, texts), keep_text=False).collect(), key=repr) == plain
    assert 10 < len(found[0]) <= repeated_passages.MOST_FREQUENT


def test_rows_cover_each_window_once_and_hold_no_window_twice():
    random.seed(5)
    raw = bytes(random.choice(b"ab") for _ in range(300)) + b"a" * 500 + b"abc" * 200
    buckets = repeated_passages.Buckets(40, 10, np.zeros(0, np.uint64))
    bucket, content, first, count = buckets.rows(np.frombuffer(raw, np.uint8), np.array([700, len(raw)]))
    covered = [p for a, n in zip(first.tolist(), count.tolist(), strict=True) for p in range(a, a + n)]
    assert sorted(covered) == [*range(661), *range(700, len(raw) - 39)]
    by_content = collections.defaultdict(set)
    of_window = collections.defaultdict(set)
    for b, c, a, n in zip(bucket.tolist(), content.tolist(), first.tolist(), count.tolist(), strict=True):
        windows = [raw[p : p + 40] for p in range(a, a + n)]
        assert len(set(windows)) == n <= 31
        by_content[c].add(raw[a : a + n + 39])
        for w in windows:
            of_window[w].add(b)
    assert all(len(x) == 1 for x in by_content.values()) and all(len(x) == 1 for x in of_window.values())


def test_a_settled_row_may_lie_in_any_batch():
    """Settling a stream in batches of one row, of a few and of all gives the same rows."""
    import pyarrow as pa

    random.seed(6)
    rows = sorted((random.randint(-2, 6), random.randint(0, 3), random.randint(0, 4), 0, random.randint(0, 2), 7) for _ in range(400))
    names = ["bucket", "content", "doc", "row", "first", "windows"]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i > 3 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=names)
    told = []
    for size in (1, 7, 400):
        out = repeated_passages._settle(iter([whole.slice(a, size) for a in range(0, 400, size)]))
        told.append(sorted(((r["bucket"], r["doc"], r["first"]) for b in out for r in b.to_pylist()), key=repr))
    heads = {}
    for b, c, d, _, f, _ in rows:
        heads.setdefault((b, c), (d, f))
    contents = collections.Counter(b for b, _ in heads)
    want = [(b, *heads[b, c]) for b, c in heads if b < 0 or contents[b] > 1]
    want += [(None, d, f) for b, c, d, _, f, _ in rows if (d, f) != heads[b, c]]
    assert told[0] == told[1] == told[2] == sorted(want, key=repr)


def clusters_by_hand(rows, k, rounds, seed=3):
    start = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), x) for i, x in rows)
    centroids = [list(x) for _, x in start[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min((far(x, c), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        members = collections.defaultdict(list)
        for _, x in rows:
            members[nearest(x)[1]].append(x)
        for c, m in members.items():
            centroids[c] = [math.floor(Fraction(sum(col), len(m))) for col in zip(*m, strict=True)]
    return sorted(((i, nearest(x)[1], nearest(x)[0]) for i, x in rows), key=repr), centroids


@pytest.mark.parametrize("size", [1.0, 1e9, 3e38])
def test_clusters(spark, size):
    """Nulls, NaN, infinite, short and long vectors are left out; repeated ids and vectors, ties and huge components are exact."""
    random.seed(9)
    vec = lambda: [float(np.float32(random.choice([-1, 0, 0.5, 1e-30, random.random()]) * size)) for _ in range(8)]
    rows = [(i % 90, vec()) for i in range(100)] + [(None, vec()), (None, [0.0] * 8), (500, [0.0] * 8), (501, [0.0] * 8)]
    bad = [(600, None), (601, []), (602, [1.0] * 7), (603, [1.0] * 9), (604, [1.0] * 7 + [None]), (605, [1.0] * 7 + [float("nan")]), (606, [1.0] * 7 + [float("-inf")])]
    df = spark.createDataFrame([(i, x, 1, 0) for i, x in rows + bad], "vec_id long, embedding array<float>, cluster int, distance int").repartition(3)
    whole = [(i, tuple(math.floor(Fraction(v) * 1024) for v in x)) for i, x in rows]
    out, centroids = centroid_clusters.clusters(df, k=8, rounds=4, width=8)
    want, want_centroids = clusters_by_hand(whole, 8, 4)
    got = centroid_clusters.with_inertia(out).collect()
    fits = lambda d: d if d < 2**63 else None
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(((i, c, fits(d)) for i, c, d in want), key=repr)
    assert centroids == want_centroids
    total = sum(d for *_, d in want)
    assert {r.inertia for r in got} == {fits(total)}
    if size == 1.0:
        own = collections.Counter()
        for _, c, d in want:
            own[c] += d
        assert {(r.cluster, r.cluster_inertia) for r in got} == set(own.items())


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    few, centroids = centroid_clusters.clusters(spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.25, 1e300])], schema), width=2)
    assert [tuple(r) for r in few.collect()] == [(1, 0, 0)] and centroids == [[512, 1024]]
    none, centroids = centroid_clusters.clusters(spark.createDataFrame([], schema), width=2)
    assert centroid_clusters.with_inertia(none).count() == 0 and centroids == []


def test_nearest_is_exact_and_looks_at_few():
    rng = np.random.default_rng(2)
    middle = rng.integers(-400, 400, 60)
    centroids = (rng.integers(-200, 200, (60, 64)) + middle[:, None]).tolist() + [[7] * 64, [7] * 64]
    x = np.concatenate([np.array(centroids)[rng.integers(0, 60, 500)] + rng.integers(-30, 30, (500, 64)), np.full((3, 64), 7)])
    number, distance, computed = centroid_clusters.Centroids(centroids).nearest(x)
    every = ((x[:, None] - np.array(centroids)) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all() and (number[-3:] == 60).all()
    assert computed < 0.5 * every.size


def collocations_by_hand(rows, least, covered, top):
    counts, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, 6):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= covered * a for q, f in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    random.seed(10)
    words = ["de", "la", "É", "été", "New", "york", "a", "b", "x\x01y", "日本", *(f"w{i}" for i in range(40))]
    phrases = ["new York city", "de la mer", "a b a b a b a b a b", "one two three four five six seven", "x\x01y x z", "x x\x01 z"]
    text = lambda n: "".join(random.choice([random.choice(words), random.choice(words), random.choice(phrases)]) + random.choice([" ", " ", "\t ", " ", " ", " ", ". ", ",", "\n", "\r\n", "\x0b"]) for _ in range(n))
    passage = " ".join(random.choice(words) for _ in range(90))
    rows = [(1, None, "en"), (2, "", None), (3, " .,; \n", "en"), (4, "a " * 3000, "en"), (None, text(30), None), (5, text(10), "und")]
    rows += [(10 + i, text(40) + passage + text(5), random.choice(["en", "en", "fr"])) for i in range(40)]
    return rows + rows[-3:]


@pytest.mark.parametrize("least,covered,top", [(3, 100, 2000), (5, 60, 20)])
def test_collocations(spark, prose, least, covered, top):
    """Null and empty texts, a constant text of one piece, passages over many chunks, repeated rows, ties, words with odd characters."""
    out = collocations.collocations(table(spark, prose).repartition(3), least, covered, top)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())
    assert got == collocations_by_hand(prose, least, covered, top) and len(got) > 20
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_collocations_of_nothing(spark):
    assert collocations.collocations(table(spark, [])).count() == 0
    assert collocations.collocations(table(spark, [(1, None, None), (2, "...", "en")])).count() == 0


def test_chunks_overlap_and_repeat(prose):
    """Chunks laid over their overlaps give the piece again; a passage within other words is cut alike."""
    random.seed(11)
    hashes = collocations.Hashes()
    passage = [b"p%d" % random.randint(0, 500) for _ in range(300)]
    seen = []
    for _ in range(5):
        piece = [b"q%d" % random.randint(0, 500) for _ in range(random.randint(0, 40))] + passage + [b"r%d" % random.randint(0, 500) for _ in range(random.randint(0, 40))]
        chunks = collocations.chunks_of([piece], hashes)
        again = []
        for c in chunks:
            words = c.rstrip(b"\n").split(b" ")
            assert c.endswith(b"\n") == (c != chunks[-1]) and (not again or again[-4:] == words[:4])
            again += words[4 if again else 0 :]
        assert again == piece
        seen.append(set(chunks))
    assert len(set.intersection(*seen)) >= 8


def test_phrases_told_by_text_are_those_of_frequent_triples(spark):
    """Of texts whose pairs are all frequent and whose triples are not, only the planted phrases are told by their text."""
    random.seed(12)
    words = [f"v{i}" for i in range(15)]
    rows = [(i, " ".join(random.choice(words) for _ in range(600)) + ", p q r s t u, p q r", "en") for i in range(40)]
    entries = collocations.dictionary(table(spark, rows).repartition(3))
    pairs = np.full(collocations.FILTER_WORDS, -1, np.int64).view(np.uint64)
    told = collocations.long_phrases(entries, spark.sparkContext.broadcast(pairs), 40).groupBy("phrase").agg(F.sum("n").alias("n")).collect()
    want = {"p q r": 80, "q r s": 40, "r s t": 40, "s t u": 40, "p q r s": 40, "q r s t": 40, "r s t u": 40, "p q r s t": 40, "q r s t u": 40}
    assert {r.phrase: r.n for r in told} == want
    out = collocations.collocations(table(spark, rows).repartition(3), 40, 100, 2000)
    got = sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect())
    assert got == collocations_by_hand(rows, 40, 100, 2000)


def test_words_of_larger_batches(monkeypatch):
    """Batches joined, and words hashed, as word by word; words are told apart by language."""
    monkeypatch.setattr(collocations, "COUNT_BYTES", 60)
    schema = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("n", pa.int64())])
    parts = (["en", "fr"], ["é b", "b c d"]), ([], []), (["en"], ["x\xa0y"]), (["fr"], ["b"])
    batches = [pa.RecordBatch.from_pydict({"lang": lang, "chunk": chunk, "n": [1] * len(lang)}, schema) for lang, chunk in parts]
    hashes, seen = collocations.Hashes(), []
    for batch in collocations._larger(iter(batches)):
        c = collocations._Words(batch, "chunk", hashes)
        want = [(lang, w) for lang, x in zip(batch["lang"].to_pylist(), batch["chunk"].to_pylist(), strict=True) for w in x.split(" ")]
        h = [collocations.mix64(hashes.of([w.encode()]) + hashes.of([b"\0" + lang.encode()]))[0] for lang, w in want]
        assert c.h.tolist() == h and c.joined(c.starts, c.ends).to_pylist() == batch["chunk"].to_pylist()
        seen += want
    assert seen == [("en", "é"), ("en", "b"), ("fr", "b"), ("fr", "c"), ("fr", "d"), ("en", "x\xa0y"), ("fr", "b")]


@pytest.mark.parametrize("step", ["parse", "pairs", "runs", "triples", "phrases"])
def test_workers_hold_little_of_a_large_batch(step):
    """A batch of 9 MB is taken in parts, and what is returned comes in small batches, with the same sums."""
    rng, rows, size = np.random.default_rng(5), 4000, 400
    words = np.array([f"w{i}" for i in range(5000)])[rng.integers(0, 5000, (rows, size))]
    texts, full = [" ".join(x) for x in words], SimpleNamespace(value=np.full(collocations.FILTER_WORDS, -1, np.int64).view(np.uint64))
    run, columns, n = {
        "parse": (collocations._parse, {"text": texts}, None),
        "pairs": (collocations._pair_counts(full), {"chunk": texts, "last": [True] * rows}, size - 1),
        "runs": (collocations._runs(full), {"chunk": texts, "last": [True] * rows}, 1),
        "triples": (collocations._triples, {"words": texts, "starts": [size - 2] * rows}, size - 2),
        "phrases": (collocations._phrases(full), {"words": texts, "starts": [size - 2] * rows}, 3 * (size - 3)),
    }[step]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * rows} | columns | {"n": [1] * rows})
    seen, sizes, summed = Counter(), [], 0
    tracemalloc.start()
    try:
        for out in run(iter([batch])):
            sizes.append(out.nbytes)
            summed += int(out["n"].to_numpy().sum())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert max(sizes) < 6 << 20 and most < 90 << 20
    assert n is None or summed == n * rows
    if step == "pairs":
        for out in run(iter([batch])):
            for h1, h2, k in zip(*(out[c].to_pylist() for c in ("h1", "h2", "n")), strict=True):
                seen[h1, h2] += k
        assert sorted(seen.values()) == sorted(Counter(p for x in words.tolist() for p in pairwise(x)).values())
