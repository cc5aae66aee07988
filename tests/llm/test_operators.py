"""The training-data operators against brute force, on small tables with nulls, repeats and odd texts."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import decontamination, line_dedup, mixing, near_dedup, ngram_lm, pii, quality, queries, token_counts, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, bitmap string"


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))
    texts = [(1, None), (2, ""), (3, "a b"), (4, "same line\nother one\nsame line"), (5, long), (6, long + " end"), (7, "same line\n x"), (None, "no id here at all"), (8, "a b"), (8, "a b"), (9, "été 日本 \U0001f642"), (10, " \t\n ")]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if i != 4 else None, len(t or ""), 0.5, "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mixing(docs, empty):
    out = mixing.pareto_mix(docs).collect()
    assert len(out) == 12 and all(r.taken <= 2 * r.size for r in out)
    assert sorted(map(tuple, mixing.pareto_mix(docs).collect()), key=repr) == sorted(map(tuple, out), key=repr)
    sizes = collections.Counter()
    for r in out:
        sizes[r.source] += r.size
    targets = {r.source: r.target for r in out}
    assert math.isclose(sum(targets.values()), 1.5 * sum(sizes.values())) and all(targets[s] <= 2 * sizes[s] + 1e-9 for s in sizes)
    assert mixing.pareto_mix(empty).count() == 0


def test_mixing_includes_documents_as_often_as_it_says(spark, monkeypatch):
    """200 sources of the same documents: how often each gets its second copy agrees with its inclusion probability,
    which differs by size; targets are met within a document; a source too large for a broadcast gives the same mix."""
    words = [3, 5, 8, 13, 21, 34, 55, 89, 120, 150, 200, 260] * 5
    rows = [(1000 * s + i, " ".join(["w"] * n), f"s{s}") for s in range(200) for i, n in enumerate(words)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.pareto_mix(df, weights=(1.0,), share=1.5, rounds=1).collect()
    p, hit, expected = collections.defaultdict(set), collections.Counter(), 0
    left = collections.Counter()
    for r in out:
        i = r.doc_id % 1000
        p[i].add(round(r.inclusion, 9))
        hit[i] += r.copies == 2
        left[r.source] += r.taken
        assert r.copies in (1, 2) and r.target == 1.5 * r.source_size == 1.5 * sum(words)
    chance = {i: next(iter(x)) for i, x in p.items()}
    assert all(len(x) == 1 for x in p.values()) and math.isclose(sum(chance[i] * n for i, n in enumerate(words)), 0.5 * sum(words), rel_tol=1e-9)
    assert max(chance.values()) > 2 * min(chance.values())
    by_size = collections.defaultdict(list)
    for i, n in enumerate(words):
        by_size[n].append(i)
    for n, same in by_size.items():
        want, got = chance[same[0]], sum(hit[i] for i in same) / (200 * len(same))
        assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / (200 * len(same))) + 0.03, (n, want, got)
    assert all(0 <= 1.5 * sum(words) - x <= max(words) for x in left.values())
    monkeypatch.setattr("millrace.llm.common.BROADCAST_ROWS", 10)
    again = mixing.pareto_mix(df, weights=(1.0,), share=1.5, rounds=1).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))


def test_mixing_preference_and_odd_rows(spark):
    rows = [(i, "a b c d", "s", 10.0 if i % 2 else 1.0) for i in range(100)] + [(200, None, None, None), (201, "", None, 1.0), (202, "x y", None, None), (203, "x y", None, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    out = {r.doc_id: r for r in mixing.pareto_mix(df, share=1.3, preference=F.col("target")).collect()}
    assert sum(out[i].copies for i in range(1, 100, 2)) > 1.3 * sum(out[i].copies for i in range(0, 100, 2))
    assert out[200].taken == out[201].taken == 0 and out[1].inclusion > 5 * out[0].inclusion
    blank = mixing.pareto_mix(df.filter("doc_id in (200, 201)")).collect()
    assert [(r.size, r.taken, r.target) for r in blank] == [(0, 0, 0.0)] * 2


def test_quality(docs, empty):
    rows = quality.quality_rules(docs).collect()
    assert len(rows) == 12 and quality.quality_rules(empty).count() == 0
    text = "a b c d a b c x a b\n\nq r\nq r"
    r = quality.text_stats(docs.limit(1).withColumn("text", F.lit(text))).first()
    words = text.split()
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    assert (r.n_words, r.n_repeat_words, r.n_dup_lines, r.word_chars) == (len(words), len(hit), 1, len("".join(words)))


def test_quality_judges_small_groups(spark):
    """An outlier planted in a group of five is rejected by its language's, its source's or all rows' estimate."""
    rng = np.random.default_rng(3)

    def row(i, lang, source, odd=False):
        n = int(rng.integers(150, 250))
        return (i, lang, source, n, int(n * (14.0 if odd else rng.normal(4.5, 0.1))), n if odd else int(rng.integers(0, 3)), 0, 12, 0)

    places = [("en", "web")] * 200 + [("de", "web")] * 20
    small = {"language": ("en", "rare"), "source": ("fr", "web"), "all": ("xx", "lone"), "null": (None, None)}
    rows = [row(i, *p) for i, p in enumerate(places)]
    odd = {}
    for k, (name, p) in enumerate(small.items()):
        at = 1000 + 10 * k
        rows += [row(at + j, *p, odd=j == 4) for j in range(5)]
        odd[at + 4] = name
    columns = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_lines long, n_repeat_words long"
    out = quality.robust_outliers(spark.createDataFrame(rows, columns)).collect()
    assert len(out) == len(rows) and all(r.distance2 is not None for r in out)
    assert {r.doc_id for r in out if not r.kept} == set(odd)
    few = quality.robust_outliers(spark.createDataFrame(rows[-5:], columns)).collect()
    assert [r.doc_id for r in few if not r.kept] == [rows[-1][0]]


def _least_core(x, least):
    """The least log determinant of all cores of the given size, as the operator measures it."""
    best = (math.inf, None)
    for core in itertools.combinations(range(len(x)), math.ceil(quality.CORE * len(x))):
        part = x[list(core)]
        cov = np.cov(part.T, bias=True) * quality.CONSISTENCY
        np.fill_diagonal(cov, np.maximum(np.diag(cov), np.square(least)))
        best = min(best, (np.linalg.slogdet(cov)[1], core))
    return best


def test_least_determinant_is_that_of_all_cores(spark):
    """Three groups of twelve rows, three outliers in each: the estimate's determinant is the least of 220 cores, and
    its distances are those of numpy."""
    rng = np.random.default_rng(8)
    names, least = [f"x{i}" for i in range(4)], [0.01] * 4
    groups = {}
    for m in range(3):
        x = rng.normal(size=(12, 4)) @ (np.eye(4) + 0.3 * rng.normal(size=(4, 4)))
        x[rng.permutation(12)[:3]] += rng.choice([-1, 1], 4) * rng.uniform(15, 25, 4)
        groups[m] = x
    fit = spark.createDataFrame([(m, *map(float, r)) for m, x in groups.items() for r in x], "model long, x0 double, x1 double, x2 double, x3 double")
    found = {r.model: r for r in quality.covariance_determinants(fit, names, least).collect()}
    for m, x in groups.items():
        want, core = _least_core(x, least)
        assert abs(found[m].log_det - want) < 0.01
        part = x[list(core)]
        factor = np.array([[found[m][f"l_{i}_{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        assert np.allclose(factor @ factor.T, np.cov(part.T, bias=True) * quality.CONSISTENCY, atol=1e-6)
        assert np.allclose([found[m][f"m_{i}"] for i in range(4)], part.mean(0))


def test_quality_statistics_of_odd_texts(spark):
    texts = ["# a * b $ c", "x\n\nx\n \nx", "\t\x0b \r\n", "日本 é | <b>&%", "a b c " * 40, None, "one two"]
    df = spark.createDataFrame([(i, t, None, "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    rows = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        windows = collections.Counter(zip(words, words[1:], words[2:]))
        hit = {k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), len("".join(words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(words) < 50 or 2 * len(hit) > len(words)) and not (r.base_failed and r.kept)


def test_lines(docs, empty):
    got = {(r.doc_id, r.kept_text) for r in line_dedup.dedup_lines(docs, least_docs=2).collect()}
    assert {(4, "other one"), (7, " x"), (1, ""), (9, "été 日本 \U0001f642")} <= got
    first = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs, least_docs=2, keep="first").collect()}
    assert first[4] == "same line\nother one" and first[7] == " x" and first[3] == "a b"
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_of_a_hash_over_many_partitions(spark):
    """One line is in every document, so that its hash fills most partitions of the sort; another is in half of them."""
    texts = {i: "\n".join(["Common ", f"own {i}", *(["half"] if i % 2 else []), "common"]) for i in range(400)}
    table = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    none = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(table, least_docs=10).collect()}
    assert none == {i: f"own {i}" for i in texts}
    first = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(table, least_docs=10, keep="first").collect()}
    assert first == {i: {0: "Common \nown 0", 1: "own 1\nhalf"}.get(i, f"own {i}") for i in texts}
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(table, least_docs=401).collect()} == dict.fromkeys(texts, 0)


def test_first_line_of_a_hash_that_crosses_an_edge(spark):
    """Four hashes over seven or so range partitions that AQE doesn't coalesce: most begin inside one and end in another."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    texts = {i: "alpha\nbeta\ngamma\ndelta" for i in range(600)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for parts in (3, 5, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            first = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(table, least_docs=10, keep="first").collect()}
            assert first == {i: texts[0] if i == 0 else "" for i in texts}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_near(spark, docs, empty):
    rows = near_dedup.near_duplicates(docs, 3, 85, 100).collect()
    got = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 12 and got[6] == 5 and got[8] == 3 and got[1] == 1 and got[2] == 2 and got[10] == 10
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_group_against_brute_force(spark):
    """A group whose members lie around the threshold, so that pivots and prefixes all have to be used."""
    rng = np.random.default_rng(3)
    base = [f"v{i}" for i in range(120)]
    texts = [[w if rng.random() > e else f"m{rng.integers(1 << 30)}" for w in base] for e in rng.uniform(0, 0.06, 120)]
    sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85, 100).collect()}
    assert got == {i: find(i) for i in range(len(sets))}


def test_near_query_against_exact_search(spark, sf):
    """Every document of the given table has the component that all pairs with a shared rare shingle give."""
    sf = sf.replace("sf0.001", "sf0.01")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    often = collections.Counter(x for s in sets for x in s)
    lists, component = collections.defaultdict(list), list(range(len(sets)))
    for i, s in enumerate(sets):
        # Two sets that are linked share one of so many of their rarest shingles.
        rare = sorted(s, key=lambda x: (often[x], x))[: len(s) - math.ceil(0.85 * len(s)) + 1]
        for j in {j for x in rare for j in lists[x]}:
            n = len(s & sets[j])
            if 100 * n >= 85 * (len(s) + len(sets[j]) - n) and component[i] != component[j]:
                component = [component[j] if c == component[i] else c for c in component]
        for x in rare:
            lists[x].append(i)
    least = {}
    for r, c in zip(rows, component):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    want = {r.doc_id: (least[c], len(s)) for r, c, s in zip(rows, component, sets)}
    assert {r.doc_id: (r.component_id, r.n_shingles) for r in queries.op7_near_dedup(spark, sf).collect()} == want and len(least) < len(rows)


def test_near_blocks_of_a_hot_group(spark, monkeypatch):
    """Groups of 40 and 160 around the threshold among other documents, in blocks of 16: components are those of brute
    force, and what is written as pairs grows with the group, not with its square."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "SPREAD", 20)
    pairs = {}
    real = near_dedup.written

    def counted(df, name):
        out = real(df, name)
        if name in ("near", "links", "block-links"):
            pairs[name] = pairs.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    seen = {}
    for size in (40, 160):
        rng = np.random.default_rng(7)
        base = [f"v{i}" for i in range(100)]
        texts = [[w if rng.random() > e else f"m{rng.integers(30)}" for w in base] for e in rng.uniform(0, 0.09, size)]
        texts += [[f"o{rng.integers(5000)}" for _ in range(40)] for _ in range(100)]
        sets = [{tuple(t[i : i + 3]) for i in range(len(t) - 2)} for t in texts]
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(len(sets)):
            for j in range(i):
                n = len(sets[i] & sets[j])
                if n and 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
        pairs.clear()
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85, 100).collect()}
        assert got == {i: find(i) for i in range(len(sets))}
        seen[size] = dict(pairs)
    assert len({find(i) for i in range(160)}) > 10
    assert all(sum(seen[n].values()) <= 2 * 28 * (n + 100) for n in seen)
    assert sum(seen[160].values()) <= 8 * sum(seen[40].values())


def test_block_links_join_what_is_linked():
    """Within one block and across two: the links found join the same components as all pairs do."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 1 << 62, 120).astype(np.uint64)
    sets = [np.unique(np.where(rng.random(120) < e, rng.integers(1, 1 << 62, 120).astype(np.uint64), base)) for e in rng.uniform(0, 0.15, 90)]
    signatures = [near_dedup.pack(near_dedup.minima(s)) for s in sets]
    names = [bytes([i]) for i in range(90)]

    def groups(edges):
        parent = {n: n for n in names}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        return {n: frozenset(m for m in names if find(m) == find(n)) for n in names}

    for mine in ([0] * 90, [i % 2 for i in range(90)]):
        every = [(names[i], names[j]) for i in range(90) for j in range(i) if (len(set(mine)) == 1 or mine[i] != mine[j]) and near_dedup.linked(sets[i], sets[j], 85, 100)]
        got = near_dedup.block_links(names, names, mine, 0, signatures, [[i] for i in range(90)], sets, 85, 100)
        assert len(every) > 2 * len(got) > 20 and set(got) <= set(every) | {(b, a) for a, b in every}
        assert groups(got) == groups(every)
    assert near_dedup.block_links(names, [b"x"] * 90, [0] * 90, 0, signatures, [[i] for i in range(90)], sets, 85, 100) == []
    # Pairs that share an earlier band are that band's to look at.
    assert near_dedup.block_links(names, names, [0] * 90, 1, signatures, [[5, i] for i in range(90)], sets, 85, 100) == []


def test_bands_lose_few_pairs():
    for least in (0.8, 0.85, 0.9):
        bands, rows = near_dedup.banding(least)
        assert bands * rows <= near_dedup.MINIMA and (1 - least**rows) ** bands <= near_dedup.MISS


def test_decontamination(spark, empty):
    item = " ".join(f"t{i}" for i in range(30))
    words = item.split()
    swapped = " ".join("zz" if i in (6, 13, 21) else w for i, w in enumerate(words))
    rows = [(1, f"before {item.upper()} after"), (2, f"x y {swapped} z"), (3, " ".join(words[:9])), (4, None), (5, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short one")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.overlaps(df, bench).collect()} == {(1, 7), (2, 7)}
    assert decontamination.overlaps(empty, bench).count() == 0 and decontamination.overlaps(df, bench.limit(0)).count() == 0


def test_decontamination_of_short_items_and_of_a_stretch_inside_a_longer_one(spark):
    words = [f"t{i}" for i in range(63)]
    inside = [f"z{i}" if i >= 20 and (i - 20) % 3 == 0 and i < 62 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(inside)), (2, "so Short one, it is, a short one"), (3, "one short"), (4, "nine " * 8 + "nine"), (5, "nine " * 8), (2, "so Short one, it is, a short one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words)), (8, ""), (9, "short one"), (10, "nine " * 9)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.equal, r.overlap, r.at) for r in decontamination.overlaps(df, bench).collect()}
    assert set(got) == {(1, 7), (2, 9), (4, 10)} and got[2, 9] == (2, 2, 1) and got[4, 10] == (9, 9, 0)
    rng = np.random.default_rng(2)
    for _ in range(300):
        same = rng.random(rng.integers(1, 40)) < rng.choice([0.3, 0.7, 0.8, 0.9])
        n = len(same)
        fit = [(b - a, -a) for a in range(n) for b in range(a + 1, n + 1) if same[a] and same[b - 1] and 5 * same[a:b].sum() >= 4 * (b - a)]
        size, at = max(fit, default=(0, 0))
        equal, s, e = decontamination.best_stretch(same, 13)
        assert (e - s, s) == ((size, -at) if size >= 13 else (0, 0)) and equal == same[s:e].sum()


def test_decontamination_finds_replaced_tokens():
    """Of overlaps of ten and more tokens with a fifth replaced, anywhere, the masks miss one in fifty at most."""
    rng = np.random.default_rng(6)
    for n in (5, 9, 10, 11, 12, 13, 15, 20):
        item = rng.integers(1, 1 << 62, n).astype(np.uint64)
        own = decontamination.seeds(item, n)
        missed = 0
        for _ in range(400):
            copy = item.copy()
            copy[rng.permutation(n)[: decontamination.allowed(n)]] = rng.integers(1, 1 << 62, decontamination.allowed(n)).astype(np.uint64)
            missed += not any((a == b).any() for a, b in zip(own, decontamination.seeds(copy, n), strict=True))
        assert missed <= (0 if n < decontamination.LEAST_TOKENS else 8), n


def test_decontamination_against_brute_force(spark):
    """Documents with mutated passages of items of 3 to 40 tokens: what all diagonals and stretches give is found."""
    rng = np.random.default_rng(9)
    items = {i: [f"i{i}w{k}" for k in range(n)] for i, n in enumerate([3, 5, 8, 10, 11, 12, 13, 20, 40])}
    rows = []
    for d in range(150):
        i = int(rng.integers(len(items)))
        share = rng.choice([0, 0.1, 0.2, 0.35])
        rows.append((d, [f"d{d}x{k}" for k in range(5)] + [w if rng.random() >= share else "zz" for w in items[i]] + ["end"] * int(rng.integers(3))))
    want = set()
    for d, words in rows:
        for i, item in items.items():
            for shift in range(-len(item) + 1, len(words)):
                same = [0 <= k + shift < len(words) and words[k + shift] == w for k, w in enumerate(item)]
                if len(item) < 13:
                    hit = 0 <= shift <= len(words) - len(item) and 5 * sum(same) >= 4 * len(item)
                else:
                    hit = any(same[a] and same[b - 1] and 5 * sum(same[a:b]) >= 4 * (b - a) for a in range(len(item)) for b in range(a + 13, len(item) + 1))
                if hit:
                    want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(w), 1, "x") for d, w in rows], "doc_id long, text string, item_id int, tokens string")
    bench = spark.createDataFrame([(i, " ".join(w), 2) for i, w in items.items()] * 2, "item_id long, text string, row int")
    got = [(r.doc_id, r.item_id) for r in decontamination.overlaps(df, bench).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 60 and len(got) >= 0.97 * len(want)


def test_tokens(docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library, counter = tokenizers.Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    for text in ["it's  we'll ok'v <|endoftext|> x<|endof", "  a\n\n  b\t c  ", "aaaa!!!! -----", "日本 123 ½ é", "can'tt 'LL"]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want and counter.count(text) == want[-1]
        assert len(library.encode(counter.truncate(text, 3), add_special_tokens=False).ids) <= 3
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    assert rows[1].n_tokens == 0 and rows[5].over_limit


def test_warc(spark):
    big = "<p>" + "x" * 2000 + "\r\n\r\nWARC/1.1\r\n</p>"
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, None), (4, "http://c", "tiny"), (5, "http://d", "tiny"), (None, "http://e", big)]
    got = {r.page_id: r for r in warc.page_captures(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    digest = hashlib.sha1(big.encode()).hexdigest()
    assert (got[1].record_type, got[1].refers_to, got[1].payload_digest, got[1].payload_bytes) == ("revisit", 2, digest, len(big))
    assert got[2].record_type == "response" and got[None].refers_to == 2 and got[4].record_type == got[5].record_type == "response" and got[3].payload_bytes == 0


def test_warc_of_odd_pages(spark, empty):
    """Repeated rows, equal ids with different payloads, null ids, no rows, and columns named like the results."""
    big, other = "<b>" * 500, "<i>" * 500
    rows = [(1, None, big, 1), (1, "u", other, 2), (2, "a\r\nb", big, 3), (2, "a", big, 3), (None, "n", other, 4), (3, "s", "x", 5), (3, "s", "x", 5)]
    out = warc.page_captures(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int")).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out), key=repr)
    want = [(1, 1500, "revisit", 2), (1, 1500, "response", None), (2, 1500, "response", None), (2, 1500, "response", None), (None, 1500, "revisit", 1), (3, 1, "response", None), (3, 1, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.page_captures(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _warc_record(kind, block, **headers):
    named = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{named}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_warc_archives_of_others(spark, tmp_path):
    """A gzip member for each record, plain files, damaged headers, cut files and captures that lack parts."""
    http = dict(Content_Type="application/http; msgtype=response")
    one = [_warc_record("response", b"HTTP/1.1 200 OK\r\n\r\nbody %d" % i + b"z" * 5000, WARC_Record_ID=f"<r{i}>", **http) for i in range(300)]
    one.append(_warc_record("request", b"GET / HTTP/1.1\r\n\r\n", WARC_Record_ID="<q7>", WARC_Concurrent_To="<r7>"))
    one.append(_warc_record("metadata", b"a: 1\r\n", WARC_Record_ID="<m9>", WARC_Concurrent_To="<r9>", Content_Type="application/warc-fields"))
    one.append(_warc_record("metadata", b"b: 1\r\n", WARC_Record_ID="<lost>", WARC_Concurrent_To="<none>", Content_Type="application/warc-fields"))
    gzip = zlib.compressobj
    members = []
    for x in one:
        z = gzip(6, zlib.DEFLATED, 31)
        members.append(z.compress(x) + z.flush())
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    bad = _warc_record("response", b"q", WARC_Record_ID="<bad>").replace(b"Content-Length: 1", b"Content-Length: one")
    good = _warc_record("response", b"HTTP/1.1 200 OK\r\n\r\nfine", WARC_Record_ID="<plain>", **http)
    cut = _warc_record("response", b"x" * 100, WARC_Record_ID="<cut>")[:-60]
    (tmp_path / "b.warc").write_bytes(b"junk before\r\n\r\n" + bad + good + cut)
    (tmp_path / "c.warc.gz").write_bytes(members[0] + members[1][:40])
    (tmp_path / "d.warc").write_bytes(b"")
    records = warc.read_warc(spark, "file://" + str(tmp_path)).collect()
    errors = collections.Counter(r.error for r in records)
    assert errors == {None: 303 + 1 + 1, "no record": 1, "no length": 1, "truncated": 1, "truncated gzip member": 1}
    captures = {r.capture_id: r for r in warc.assemble(warc.read_warc(spark, "file://" + str(tmp_path))).collect()}
    assert len(captures) == 301 and captures["<plain>"].response.payload == b"fine" and captures["<r5>"].response.payload == b"body 5" + b"z" * 5000
    assert captures["<r7>"].request.record_id == "<q7>" and captures["<r7>"].metadata is None
    assert captures["<r9>"].metadata.fields == {"a": "1"} and captures["<r9>"].request is None


def test_toxicity(spark, sf, empty):
    rows = [(i, f"the word {'idiot' if i % 3 == 0 else 'garden'} was {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    scores = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert all((scores[i] >= 0.5) == (i % 3 == 0) for i in range(90, 120))
    none = toxicity.train(df, labels.limit(0))
    assert toxicity.score(df, none).count() == 120 and toxicity.score(empty, model).count() == 0


def test_toxicity_of_a_text_is_its_own():
    """Scores don't depend on neighbours, order or batch; n-grams over a text's ends count, in training too."""
    rng = np.random.default_rng(1)
    texts = [b"abc", b"xyz", b"", "\0日x".encode(), *(bytes(rng.integers(97, 105, rng.integers(1, 9)).astype(np.uint8)) for _ in range(300))]
    model = toxicity.Model(np.arange(1, 1 << 20, 2100)[: toxicity.FEATURES], rng.normal(size=499)[: toxicity.FEATURES], 0.1)
    buckets = {b: i for i, b in enumerate(model.buckets.tolist())}

    def alone(text):
        c = [0] * 8 + [ord(x) for x in text.decode().lower()] + [0] * 8
        z, seen = model.intercept, set()
        for n in toxicity.SIZES:
            for at in range(8 - n + 1, len(c) - 8) if text else ():
                [found] = [x for size, x in toxicity.ngram_buckets(np.array(c[at : at + n], np.uint32)) if size == n]
                seen.add(int(found[0]))
        return 1 / (1 + math.exp(-z - sum(model.weights[buckets[b]] for b in seen if b in buckets)))

    want = np.array([alone(t) for t in texts])
    order = rng.permutation(len(texts))
    assert np.allclose(model.score(texts), want) and np.allclose(model.score([texts[i] for i in order]), want[order])
    assert np.allclose([model.score([t])[0] for t in texts], want)


def test_toxicity_of_odd_rows(spark, docs):
    """Nulls, empty and long texts, repeated rows and columns named like the results."""
    labels = spark.createDataFrame([(3, 1), (3, 1), (8, 0), (8, 1), (None, 1), (5, 7), (1, 0), (2, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, carry=("doc_id", "n_chars")).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.n_chars == 0}) == 1 and len({r.score for r in rows if r.doc_id == 8}) == 1
    few = toxicity._part(spark.range(100_000), 100_000, 5_000, "id").count()
    assert 4_500 < few <= 5_000


def test_toxicity_held_out(spark, sf):
    """On rows that training has not seen, most of label 1 is found and little else is called toxic, though some labels
    of the given table contradict their texts."""
    sf = sf.replace("sf0.001", "sf0.1")
    out = queries.op1_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    hit, called, toxic = (sum(x) for x in zip(*((r.predicted and r.toxic, r.predicted, r.toxic) for r in out)))
    assert toxic >= 50 and hit >= 0.7 * toxic and hit >= 0.85 * called


def test_pii(spark, docs):
    field = pii.train_field(pii.example_table(spark))
    text = "write jo.x@mail.example.com or jo at mail dot com, +1 (017) 555-7713, 10.0.0.1, 300.1.1.1 and 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text), (2, None), (3, "the and of\nin the 12 of 1999")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_personal_data(df, field).collect()}
    base = [(s.kind, text[s.start : s.end]) for s in rows[1].base]
    assert base == [("email", "jo.x@mail.example.com"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert ("email", "jo at mail dot com") in [(s.kind, text[s.start : s.end]) for s in rows[1].spans]
    assert rows[2].spans == [] and rows[3].spans == []
    held = pii.example_rows(2, 77)
    found = dict(pii.Decoder(field).decode([t for t, _ in held]))
    right = sum([pii.TAGS[k] for k in found[i]] == tags if i in found else set(tags) == {"O"} for i, (_, tags) in enumerate(held))
    assert right >= 0.95 * len(held)


def test_pii_in_long_lines(spark):
    """A spelled address is found wherever it lies in a long line."""
    decoder = pii.Decoder(pii.train_field(pii.example_table(spark)))
    spelled = "jo at mail dot com"
    for before in (3, *range(248, 260), 511, 40_000):
        text = "of the that " * (before // 3) + "and " * (before % 3) + f"write {spelled} please" + " of the that" * 100
        [(base, more)] = pii.find_spans([text], decoder)
        assert base == [] and [(k, text[s:e]) for k, s, e in more] == [("email", spelled)], before


def _plain_spans(text):
    """The fixed patterns by finditer, and the checks as they are stated."""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
        if 13 <= len(digits) <= 19 and luhn % 10 == 0:
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def test_pii_query_against_patterns(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op8_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = pii.joined(_plain_spans(texts[r.doc_id]))
        counts = collections.Counter(x.split(":")[0] for x in base.split(",") if x)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [counts[k] for k in pii.KINDS] and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))


def test_pii_patterns_of_random_strings():
    rng = np.random.default_rng(12)
    for alphabet in ("a@.-1", "1.2 0", "0123456789 -", "+1 ().-9", "a.@b+1-% (\n"):
        for _ in range(1500):
            text = "".join(rng.choice(list(alphabet), rng.integers(1, 40)))
            assert sorted(pii.base_spans(text)) == sorted(_plain_spans(text)), text


def test_viterbi_against_all_taggings(spark):
    """Of every tagging of a short line the decoder gives one with the highest sum."""
    field = pii.train_field(pii.example_table(spark))
    rng = np.random.default_rng(1)
    pool = [t for tokens, _ in pii.example_rows(1, 3) for t in tokens]
    lines = [[str(x) for x in rng.choice(pool, rng.integers(1, 5))] for _ in range(40)]
    found = dict(pii.Decoder(field).decode(lines))
    for k, line in enumerate(lines):
        e = np.array([field.weights[[field.features[f] for f in fs if f in field.features]].sum(0) for fs in pii.line_features(line)])

        def total(tags):
            return field.steps[-1][tags[0]] + sum(e[i][t] for i, t in enumerate(tags)) + sum(field.steps[a][b] for a, b in itertools.pairwise(tags))

        best = max(total(tags) for tags in itertools.product(range(len(pii.TAGS)), repeat=len(line)))
        assert total(found.get(k, np.zeros(len(line), int))) >= best - 1e-3, line


def test_pii_of_odd_rows(spark, docs, empty):
    field = pii.train_field(pii.example_table(spark))
    rows = pii.find_personal_data(docs.withColumn("base", F.lit(1)).withColumn("spans", F.lit("x")), field).collect()
    assert len(rows) == 12 and all(r.spans == [] for r in rows if r.doc_id in (1, 2, 10)) and pii.find_personal_data(empty, field).count() == 0


def test_token_counts_against_the_library(spark, sf, docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary_path()
    library = tokenizers.Tokenizer.from_file(path)
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs.select("doc_id", "text"))
    clash = table.withColumn("n_tokens", F.lit("x")).withColumn("n_bytes", F.lit(1))
    want = sorted((-1 if r.doc_id is None else r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in table.collect())
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(clash, path).collect())
    assert got == want and token_counts.token_counts(empty, path).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 9), (1, 1 << 48), (500, 1 << 20), (3000, 1 << 40), (900, 1 << 63)):
        v = np.unique(rng.integers(0, top, n).astype(np.uint64))
        ef, q = ngram_lm.EliasFano(v, top), np.r_[v, rng.integers(0, top, 500).astype(np.uint64)]
        for x in (ef, ngram_lm.EliasFano.opened(ef.stored())):
            place, hit = x.successor(q, np.zeros(len(q), np.int64), np.full(len(q), len(v)))
            assert (place == np.searchsorted(v, q)).all() and (hit == np.isin(q, v)).all() and (x.get(np.arange(len(v))) == v).all()
        a, b = np.sort(rng.integers(0, len(v) + 1, (2, len(q))), axis=0)
        place, hit = ef.successor(q, a, b)
        assert (place == np.clip(np.searchsorted(v, q), a, b)).all() and (hit == [x in v[i:j] for x, i, j in zip(q, a, b)]).all()


def test_trie_answers_as_counts_do():
    """Also when stored and opened again; a search for a successor stays between its context's pointers."""
    rng = np.random.default_rng(2)
    grams = rng.zipf(1.4, (4000, 3)) % 60
    one, two, three = (collections.Counter(map(tuple, grams[:, : k + 1].tolist())) for k in range(3))
    words = np.array(sorted(x for x, in one), np.uint64)
    pairs = sorted(two)
    built = ngram_lm.Trie.built(
        words, np.array([one[int(w),] for w in words]), np.array([int(np.searchsorted(words, a)) << 32 | b for a, b in pairs], np.uint64), np.array([two[x] for x in pairs]),
        np.array([pairs.index((a, b)) << 32 | c for a, b, c in sorted(three)], np.uint64), np.array([three[x] for x in sorted(three)]),
    )
    asked = np.r_[grams, rng.integers(0, 70, (2000, 3))].astype(np.uint64)
    for trie in (built, ngram_lm.Trie.opened(built.stored() | {"top": built.top})):
        at, n1, known = trie.word(asked[:, 0])
        at, code2, known = trie.pair(at, known, asked[:, 1])
        _, code3, _ = trie.triple(at, known, asked[:, 2])
        decode = ngram_lm.levels(trie.top)
        rows = asked.tolist()
        assert n1.tolist() == [one[a,] for a, _, _ in rows]
        assert np.allclose(decode[code2], [two[a, b] for a, b, _ in rows], rtol=0.03) and np.allclose(decode[code3], [three[tuple(x)] for x in rows], rtol=0.03)


def test_codes_of_counts():
    for top in (1, 128, 129, 5_000, 10**12):
        n = np.unique(np.r_[np.arange(129), np.geomspace(1, top, 2000).astype(np.int64)])
        n = n[n <= top]
        back = ngram_lm.levels(top)[ngram_lm.quantise(n, top)]
        assert (back[n <= 128] == n[n <= 128]).all() and (np.abs(np.log10(back[1:] / n[1:])) <= max(0.001, math.log10(max(top, 129) / 128) / 250)).all()


def _check_scores(df, scored):
    rows = [(r.doc_id, [*(r.text or "").encode().lower().split(), 0]) for r in df.collect()]
    counts = [collections.Counter() for _ in range(3)]
    for i, w in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1:
            w = [1, 1, *w]
            for k in range(2, len(w)):
                counts[0][w[k]] += 1
                counts[1][w[k - 1], w[k]] += 1
                counts[2][tuple(w[k - 2 : k + 1])] += 1
    one, two, three = counts
    three = collections.Counter({k: c for k, c in three.items() if c >= ngram_lm.LEAST_TRIPLES})
    n, v, m, m3, documents = sum(one.values()), len(one), ngram_lm.PRIOR, ngram_lm.TRIPLE_PRIOR, one[0]
    p1 = lambda x: (one[x] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda a, x: (two[a, x] + m * p1(x)) / ((documents if a == 1 else one[a]) + m)
    p3 = lambda a, b, x: (three[a, b, x] + m3 * p2(b, x)) / ((documents if b == 1 else two[a, b]) + m3)
    want = []
    for i, w in rows:
        known, padded = sum(x in one for x in w), [1, 1, *w]
        score = sum(math.log10(p3(*padded[k : k + 3])) for k in range(len(w)))
        want.append((-1 if i is None else i, len(w), known, n, sum(math.log10(p1(x)) for x in w), score))
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in scored.collect())
    assert len(got) == len(want)
    for g, x in zip(got, sorted(want)):
        assert g[:4] == x[:4] and math.isclose(g[4], x[4], rel_tol=1e-9) and abs(g[5] - x[5]) <= 0.003 * x[1]


def test_lm(spark, sf, docs, empty):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    _check_scores(df, ngram_lm.score_documents(df))
    _check_scores(docs.unionByName(docs), ngram_lm.score_documents(docs.unionByName(docs)))
    assert ngram_lm.score_documents(empty).count() == 0


def test_lm_in_many_batches_and_shards(spark):
    """Contexts and counts add up over batches, and a pair's triples over shards."""
    rows = [(i, " ".join(["very common", f"w{i % 40}", *(f"x{(i * k) % 17}" for k in range(20)), "very common end"])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _check_scores(df, ngram_lm.score_documents(df, batch_tokens=600, shard_tokens=400))


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = cp.near_deduplication(spark, docs, sf)
    assert near.columns == list(cp.COLUMNS)
    found = near_dedup.near_duplicates(docs).filter("n_shingles > 0").select("component_id").distinct().count()
    assert near.filter(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")) > 0).count() == found
    clean = cp.benchmark_decontamination(spark, docs, sf)
    bad = {r.doc_id for r in queries.op2_decontamination(spark, sf).collect()}
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == bad
    assert cp.run(spark, sf).count() > 0


PIPELINE_DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _pipeline_tables(spark, folder, rows):
    spark.createDataFrame(rows, PIPELINE_DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(20))), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_on_planted_cases(spark, tmp_path):
    """Each stage, on a table with nulls, repeated rows, toxic texts, shared lines, copies and a benchmark passage."""
    import corpus_pipeline as cp

    rng = np.random.default_rng(3)
    own = lambda n: " ".join(f"w{rng.integers(10_000)}" for _ in range(n))
    rows = [(i, own(12) + (" you idiot moron scum" if i % 4 == 0 else "") + ("\nshared footer line" if i % 2 else ""), "en", f"s{i % 3}", 9) for i in range(60)]
    copy = own(30)
    rows += [(100, copy, "en", "s0", 5), (101, copy + " tail", "en", None, 5), (102, copy, None, "s1", 5)]
    rows += [(110, own(10) + " " + " ".join(f"bench{i}" for i in range(20)) + " " + own(5), "en", "s0", 5), (120, None, None, None, None), (121, "", "en", "s0", 0), (121, "", "en", "s0", 0), (None, "no id " + own(9), "en", "s2", 3)]
    rows += [(130, own(9), "en", "s0", 1)] * 2
    folder = str(tmp_path / "sf")
    _pipeline_tables(spark, folder, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(-1 if r.doc_id is None else r.doc_id for r in df.collect())
    clean = cp.toxicity(spark, docs, folder)
    want = sorted(-1 if i is None else i for i, t, *_ in rows if not (t and "idiot" in t))
    assert clean.columns == list(cp.COLUMNS) and ids(clean) == want
    lines = cp.line_deduplication(spark, clean, folder)
    assert [r.doc_id for r in lines.collect() if "shared footer" in r.text] == [1] and ids(lines) == want
    assert all(r.n_chars == len(r.text) for r in lines.collect() if r.doc_id in range(3, 60, 2))
    near = cp.near_deduplication(spark, lines, folder)
    assert collections.Counter(ids(near)) == collections.Counter(x for x in want if x not in (101, 102)) - collections.Counter([130])
    left = cp.benchmark_decontamination(spark, near, folder)
    assert sorted(set(ids(near)) - set(ids(left))) == [110]
    mixed = cp.source_mixing(spark, left, folder)
    assert ids(mixed) == ids(left) and all(r.taken <= 2 * r.size for r in mixed.collect())
    assert ids(cp.run(spark, folder)) == ids(left)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline as cp

    folder = str(tmp_path / "sf")
    _pipeline_tables(spark, folder, [])
    assert cp.run(spark, folder).count() == 0
