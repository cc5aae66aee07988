"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams, present or not. Training counts, over all labelled training rows, in how many texts of
either class each bucket occurs; the buckets that tell the classes apart most are kept and scaled by their log-count
ratio, and a logistic regression is fitted on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, by_bytes, row_key, written

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
FEATURES = 512
#: Training takes at most so many labelled rows, and the logistic regression so many of them: those whose hash is below
#: a limit set from the number of rows. The first bound is also what may be broadcast, below 2 MB of ids and labels.
MAX_ROWS = 50_000
MAX_FIT_ROWS = 10_000
_P = np.uint32(0x9E3779B1)
_GAP = 8


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts, A-Z lower-cased, with zeros before, between and after them; where each starts and ends."""
    parts = [t.lower().decode("utf-8", "replace").encode("utf-32-le") for t in texts]
    sizes = np.array([len(p) // 4 for p in parts], np.int64)
    starts = _GAP + np.cumsum(np.r_[0, sizes + _GAP])[:-1]
    gap = b"\0" * (4 * _GAP)
    return np.frombuffer(gap + b"".join(x for p in parts for x in (p, gap)), np.uint32), starts, starts + sizes


def ngram_buckets(c: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Size and the buckets of the n-grams at each place."""
    h = c * _P
    for n in range(2, max(SIZES) + 1):
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * (_P + np.uint32(2 * n))
        if n in SIZES:
            x = h ^ (h >> np.uint32(15))
            yield n, (x * np.uint32(0x85EBCA6B)) >> np.uint32(12)


def owners(at: np.ndarray, n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The text that holds a place of the n-gram at ``at``, -1 for none. The zeros around a text, more of them than an
    n-gram has places, are part of its first and last n-grams, so that no n-gram is two texts'."""
    owner = np.searchsorted(starts, at + n - 1, side="right") - 1
    return np.where((owner >= 0) & (at < ends[owner]) & (starts[owner] < ends[owner]), owner, -1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int32)
    rows = np.zeros(2, np.int64)
    for batch in batches:
        for label, text in zip(batch["toxic"].to_pylist(), as_bytes(batch["text"]), strict=True):
            rows[label] += 1
            if text:
                c, [start], [end] = joined([text])
                total[label][np.unique(np.concatenate([x[start - n + 1 : end] for n, x in ngram_buckets(c)]))] += 1
    for label in (0, 1):
        at = np.flatnonzero(total[label])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, label, np.int32)), pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[total[label][at], rows[label]].astype(np.int64))], names=["label", "bucket", "n"])


def _found(table: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once."""
    pairs = []
    for a, b in by_bytes(texts, 1 << 20):
        c, starts, ends = joined(texts[a:b])
        here = []
        for n, buckets in ngram_buckets(c):
            feature = table[buckets]
            at = np.flatnonzero(feature)
            owner = owners(at, n, starts, ends)
            here.append(((owner + a) * (FEATURES + 1) + feature[at])[owner >= 0])
        pairs.append(np.unique(np.concatenate(here)))
    flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    return flat // (FEATURES + 1), flat % (FEATURES + 1) - 1


@dataclass
class Model:
    """buckets of the features, their weights (log-count ratio times fitted weight) and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        t = np.zeros(BUCKETS, np.int16)
        t[self.buckets] = np.arange(1, len(self.buckets) + 1)
        return t

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self._score(self.table(), texts)

    def _score(self, table: np.ndarray, texts: list[bytes]) -> np.ndarray:
        text, feature = _found(table, texts)
        z = self.intercept + np.bincount(text, self.weights[feature], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.05, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L2-regularised logistic regression, by Newton steps."""
    n, d = x.shape
    a = np.c_[x, np.ones(n)].astype(np.float64)
    w, ridge = np.zeros(d + 1), np.r_[np.full(d, l2), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def _part(df: DataFrame, rows: int, most: int, *key: str) -> DataFrame:
    """The rows whose hash of ``key`` is below a limit, about 97 % of ``most`` of ``rows`` distinct ones; no row is sorted."""
    return df if rows <= most else df.filter(F.shiftrightunsigned(F.xxhash64(*key), 34) < int((1 << 30) * 0.97 * most / rows))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on the texts of ``docs`` that ``labels`` (doc_id, toxic: 0 or 1; other values are left out) marks.

    Repeated rows of either table count once; a document with both labels counts for both. Null ids mark nothing, null
    texts have no n-grams, and texts of any length are taken whole. Without rows of both classes, as with an empty
    table, the model has no features and scores every text with the share of label 1. Other columns are not looked at.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    marked = _part(marked, marked.count(), max_rows, "doc_id")
    found = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    rows = written(found.dropDuplicates(["row", "toxic"]), "labelled")
    counts = rows.select("toxic", "text").mapInArrow(_counts, "label int, bucket int, n long").groupBy("bucket").agg(F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("neg"))
    totals = counts.filter("bucket = -1").first()
    pos_rows, neg_rows = (int(totals["pos"]), int(totals["neg"])) if totals else (0, 0)
    if not pos_rows or not neg_rows:
        share = min(max(pos_rows / max(pos_rows + neg_rows, 1), 1e-6), 1 - 1e-6)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    p, q = (F.col("pos") + 0.5) / (pos_rows + 1.0), (F.col("neg") + 0.5) / (neg_rows + 1.0)
    m = (F.col("pos") + F.col("neg") + 1.0) / (pos_rows + neg_rows + 2.0)
    # Log-likelihood gain of telling the classes apart by presence; FEATURES rows come to the driver.
    half = lambda n, own: n * (own * F.log(own / m) + (1 - own) * F.log(F.greatest((1 - own) / (1 - m), F.lit(1e-12))))
    gain = half(float(pos_rows), p) + half(float(neg_rows), q)
    best = counts.filter("bucket >= 0 and pos + neg >= 3").select("bucket", F.log(p / q).alias("r"), gain.alias("gain")).orderBy(F.desc("gain"), "bucket").limit(FEATURES).toPandas()
    model = Model(best["bucket"].to_numpy(np.int64), best["r"].to_numpy(float), 0.0)
    table = model.table()

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch["text"])
            text, feature = _found(table, texts)
            x = np.zeros((len(texts), FEATURES), bool)
            x[text, feature] = True
            yield pa.RecordBatch.from_arrays([batch["toxic"], pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["toxic", "bits"])

    few = _part(rows, pos_rows + neg_rows, max_fit_rows, "row")
    fit = few.select("toxic", "text").mapInArrow(present, "toxic int, bits binary").toPandas()
    x = np.unpackbits(np.frombuffer(b"".join(fit["bits"]), np.uint8).reshape(len(fit), -1), axis=1)[:, : len(best)]
    order = np.lexsort((*x.T[:8], fit["toxic"].to_numpy()))  # sums in one order, however the rows came
    weights, intercept = fit_logistic(x[order] * model.weights, fit["toxic"].to_numpy(float)[order])
    return Model(model.buckets, weights * model.weights, intercept)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The columns in ``carry`` and the score under ``name``, 0 to 1, one row for each of ``docs``.

    Null and empty texts get the score of no feature. Equal texts have equal scores, whatever rows stand beside them.
    Texts of any length are scored whole. Columns that aren't carried may have any name. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select(*carry, F.col("text").alias("__text"))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = model.table()
        for batch in batches:
            s = model._score(table, as_bytes(batch["__text"]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(s, pa.float64())], names=[*carry, name])

    return df.mapInArrow(run, f"{types}, `{name}` double")
