"""Names near a misspelt one, nested rows and JSON values against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import columns


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 5])
def test_near_names_against_all_pairs(spark, most):
    random.seed(most)
    letters = "abé\U0001f642"
    known = {"".join(random.choice(letters) for _ in range(random.randint(0, 20))) for _ in range(120)}

    def bent(word):
        for _ in range(random.randint(0, most + 1)):
            at = random.randint(0, len(word))
            word = random.choice([word[:at] + random.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + random.choice(letters) + word[at + 1 :]])
        return word

    names = {bent(w) for w in known} | {"", "ab"}
    df = lambda words, c: spark.createDataFrame([(w,) for w in [*words, None, *list(words)[:5]]], f"{c} string")
    got = {(r.name, r.candidate, r.distance) for r in columns.nearest_names(df(names, "name"), df(known, "candidate"), most).collect()}
    want = {(a, b, d) for a, b in itertools.product(names, known) if (d := edits(a, b)) <= most and d < len(a)}
    assert got == want and len(want) > 100


def test_candidates_grow_with_the_names(spark):
    """Long names meet few others: candidates are in proportion to the names, not to their pairs."""
    made = lambda n: spark.range(n).select(F.md5(F.col("id").cast("string")).alias("candidate"))
    rows = [columns.near_candidates(made(n).select(F.overlay("candidate", F.lit("zz"), F.lit(9), F.lit(1)).alias("name")), made(n), 3).count() for n in (500, 2000)]
    assert 500 <= rows[0] and rows[1] < 6 * rows[0] < 0.03 * 2000 * 2000


def test_a_large_register_is_not_told_whole(spark, monkeypatch):
    names = spark.createDataFrame([("abc",), ("zzzz",)], "name string")
    known = spark.createDataFrame([("abd",), ("b",)], "candidate string")
    told = lambda: {r.name: r.candidates for r in columns.suggestions(names, known, 1).collect()}
    assert told() == {"abc": ["abd"], "zzzz": ["abd", "b"]}
    monkeypatch.setattr(columns, "REGISTER", 1)
    assert told() == {"abc": ["abd"], "zzzz": None}


def test_flatten_repeated(spark):
    kind = "id int, s struct<x: int, `d.t`: string>, a array<int>, b array<struct<y: string, z: array<int>>>, m map<string, int>"
    rows = [(1, (5, "t"), [1, 2, 3], [("p", [7, 8]), ("q", None)], {"k": 1}), (2, None, None, [], None), (3, (6, None), [], [("r", [9])], {})]
    df = columns.flatten_repeated(spark.createDataFrame(rows, kind))
    assert df.columns == ["id", "s.x", "s.d.t", "a", "b.y", "b.z", "m.key", "m.value"]
    got = sorted(map(tuple, df.collect()), key=repr)
    want = [(1, 5, "t", 1, "p", 7, "k", 1), (1, 5, "t", 1, "p", 8, "k", 1), (1, 5, "t", 2, "q", None, None, None), (1, 5, "t", 3, None, None, None, None), (2, *[None] * 7), (3, 6, None, None, "r", 9, None, None)]
    assert got == sorted(want, key=repr)
    flat = spark.range(2)
    assert columns.flatten_repeated(flat).columns == ["id"] and columns.flatten_repeated(flat.limit(0)).count() == 0


def test_json_values(spark):
    texts = ['[1, "b", null]', " [] ", '{"b": 2, "a": 1}', "nothing", None, "(1, 2)", '("x",)', "[[1], {}]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", columns.json_list(F.col("t")).alias("l"), columns.json_dict(F.col("t"), "int").alias("d"), columns.json_tuple(F.col("t"), "int", "string").alias("two"), columns.json_tuple(F.col("t"), "string").alias("one"))
    out = out.withColumn("keys", F.map_keys("d"))
    got = {r.t: r for r in out.collect()}
    assert got[texts[0]].l == ["1", "b", None] and got[" [] "].l == [] and got["nothing"].l is None and got[None].l is None and got[texts[2]].l is None
    assert got[texts[2]].keys == ["b", "a"] and got[texts[2]].d == {"a": 1, "b": 2} and got["[[1], {}]"].d is None
    assert tuple(got["(1, 2)"].two) == (1, "2") and tuple(got['("x",)'].one) == ("x",) and got[texts[0]].two is None
