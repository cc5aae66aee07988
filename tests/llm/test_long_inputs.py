"""Long texts and large pages: results as the library's, time and memory in proportion."""

import hashlib
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest

from millrace.llm import decontamination, queries, token_counts, warc


@pytest.fixture(scope="module")
def counter():
    pytest.importorskip("tokenizers")
    return token_counts.PrefixCounter(queries.vocabulary_path())


@pytest.mark.parametrize("unit", ["a", "=", "7", " ", "\n", " \n\t", "ab ", "-=", "é", "\U0001f642", "'s", "x \n", "!'ll", "  '", "　", "1a", "<|endoftext|>", "!<|endoftext|> \n"])
def test_cuts_of_long_texts(counter, unit):
    """Counts at all cuts of a short text of the kind, and at some of one of 100,000 characters, are the library's."""
    encoded = lambda t: len(counter.library.encode(t, add_special_tokens=False).ids)
    short = "x " + unit * (60 // len(unit)) + " y"
    assert counter.prefix_counts(short).tolist() == [encoded(short[:i]) for i in range(len(short) + 1)]
    long = unit * (100_000 // len(unit))
    began = time.time()
    counts = counter.prefix_counts(long)
    assert time.time() - began < 20
    rng = random.Random(1)
    for i in [0, 1, 2, len(long) - 1, len(long), *(rng.randrange(len(long)) for _ in range(3))]:
        assert counts[i] == encoded(long[:i])
    cut = counter.truncate(long, 50)
    assert encoded(cut) <= 50 and (len(cut) == len(long) or counts[len(cut) + 1 :].min() > 50)


def test_cuts_of_mixed_texts(counter):
    rng = random.Random(2)
    parts = ["it's", "we'll", " ", "  ", "\n", "\t", "\r\n", "word", "12", "é", "日本", "!?", "'", "''", "<|endoftext|>", "<|end", " ", "x́", "½", "_"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        want = [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, text


def test_truncated_rows(spark, counter):
    rows = [(1, None), (2, ""), (3, "a b c d"), (3, "a b c d"), (None, "=" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = token_counts.truncated(df, queries.vocabulary_path(), 2).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, counter.truncate("=" * 5000, 2))], key=repr)
    assert token_counts.truncated(df.limit(0), queries.vocabulary_path(), 2).count() == 0


def test_large_pages_among_small_ones(spark, tmp_path):
    """Archives hold 16 MB or one capture, whatever the mean is; long urls and pages come back whole."""
    big = lambda i, n: (f"<p>{i}" + "0123456789abcdef" * (n // 16))[:n]
    rows = [(i, f"http://h/{i}", big(i, 9_000)) for i in range(300)] + [(1000 + i, f"http://h/b{i}", big(i, 10_000_000)) for i in range(5)] + [(2000, "http://" + "u" * 3_000_000, "x"), (2001, None, big(7, 600_000)), (2002, "http://c", big(7, 600_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_captures(df, str(tmp_path / "w"))
    sizes = [sum(map(len, warc._content(p.read_bytes()))) for p in (tmp_path / "w").rglob("*.gz")]
    assert max(sizes) <= warc.ARCHIVE_BYTES and len([s for s in sizes if s > 9_000_000]) == 6
    got = {r.page_id: r for r in warc.page_captures(df).collect()}
    assert len(got) == len(rows) and all(got[i].payload_bytes == len(h) and got[i].payload_digest == hashlib.sha1(h.encode()).hexdigest() for i, _, h in rows)
    assert got[2000].record_type == "response" and (got[2001].record_type, got[2001].refers_to) == ("revisit", 2002) and len(got[2000].target_uri) == 3_000_007


def test_decompression_is_bounded():
    """A member of 200 MB comes out in pieces of CHUNK bytes, in little memory."""
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    block = b"z" * (1 << 20)
    data = b"".join(z.compress(block) for _ in range(200)) + z.flush()
    tracemalloc.start()
    pieces = [len(p) for p in warc._content(data + data[:0] + zlib.compress(b"end", wbits=31))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(pieces) == (200 << 20) + 3 and max(pieces) <= warc.CHUNK and peak < 16 << 20


def test_a_repeated_word_meets_an_item_once(spark):
    """Rows that are verified grow with the documents, not with their windows; time with the length of a text."""
    benchmark = spark.createDataFrame([(1, "ha " * 40), (2, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    took = {}
    for n in (2_000, 8_000, 32_000):
        docs = spark.createDataFrame([(1, "ha " * n), (2, " ".join(f"w{i % 30}" for i in range(n))), (3, "ho " * n), (4, None), (5, "x " * 50 + "ha " * 12)], "doc_id long, text string")
        began = time.time()
        out = {(r.doc_id, r.item_id): (r.equal, r.overlap, r["at"]) for r in decontamination.overlaps(docs, benchmark).collect()}
        took[n] = time.time() - began
        assert out == {(1, 1): (40, 40, 0), (2, 2): (30, 30, 0)}
    assert took[32_000] < 8 * took[2_000] + 5


def test_diagonals_are_all_of_them():
    rng = np.random.default_rng(3)
    doc, item = rng.integers(0, 5, 60).astype(np.uint64), rng.integers(0, 5, 20).astype(np.uint64)
    got = decontamination.diagonals(doc, np.arange(60), item, np.arange(20), 60, 20)
    assert sorted(got.tolist()) == sorted({i - j for i in range(60) for j in range(20) if doc[i] == item[j]})


def test_pipeline_on_long_texts(spark, tmp_path):
    """A text of 60,000 words, its near copy, one with a benchmark passage at its end, and a line of 100,000 characters."""
    import corpus_pipeline as cp

    rng = random.Random(4)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    bench, long = " ".join(f"bench{i}" for i in range(20)), own(60_000)
    rows = [(1, long, "en", "a", 1), (2, long + " tail", "en", "a", 1), (3, own(60_000) + " " + bench, "en", "b", 1), (4, "z" * 100_000, "en", "b", 1), (5, own(50), "en", None, 1)]
    rows += [(10 + i, own(8) + (" you idiot moron scum" if i % 4 == 0 else ""), "en", "c", 1) for i in range(40)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10 + i, 0, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert set(out) == {1, 4, 5, *(10 + i for i in range(40) if i % 4)} and out[1].size == 60_000 and out[4].size == 1


def test_targets_of_sources_against_plain_shares(spark):
    """Targets by sharing again and again what is above a source's cap, until none is."""
    from millrace.llm import mixing

    rng = random.Random(5)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 10, 1000, 10**6]) * rng.randint(1, 9) for s in [None, "", "A", "a", "b", "é", "\U0001f642", "z"][: rng.randint(1, 8)]}
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, target, free = 1.5 * sum(sizes.values()), {}, list(order)
        while free:
            share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
            over = [s for s in free if share[s] > 2 * sizes[s]]
            if not over:
                target |= share
                break
            for s in over:
                target[s] = 2 * sizes[s]
                left -= target[s]
                free.remove(s)
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2).collect()}
        assert got == pytest.approx(target)
