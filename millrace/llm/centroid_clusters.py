"""Clusters of vectors around integer centroids, each vector's nearest one found by equal-average equal-variance search.

Centroids are sorted by the sum of their components, and a vector looks at them outward from its own sum. With s the sum
and r the distance from the vector of equal components (``width`` times the variance is its square), two vectors are at
least as far apart as their sums and their deviations say: width * distance >= (s - s')**2 + width * (r - r')**2. A
centroid whose sum alone is too far off ends the search, since all that are left lie farther; one whose deviation is too
far off is passed over; of the others the squared distance is computed in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Components of a vector, and steps of one unit of them.
WIDTH, SCALE = 64, 1024
#: Sums are carried as two decimals, multiples of this and the rest, so that they are exact for all floats.
HALF = 10**25
#: Components below this are computed in 64 bits, larger ones in Python's integers.
SMALL, LARGEST = 2.0**24, 2.0**166


def quantised(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): floor(scale * component) as doubles of whole value, of vectors of ``width`` finite components."""
    x = F.transform(F.col(embedding), lambda v: F.lit(float(scale)) * v.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.size("x") == width)
    # A comparison with null or NaN isn't true: NaN is above all numbers.
    rows = rows.filter(F.forall("x", lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False))))
    # Doubles from 2**52 on are whole.
    return rows.select("vec_id", F.transform("x", lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)).alias("x"))


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles of whole value as 64-bit integers, or as Python's if they are large."""
    if not values.size or np.abs(values).max() < SMALL:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


class Centroids:
    """Centroids in the order of their sums."""

    def __init__(self, rows: list[list[int]]):
        small = all(abs(v) < SMALL for r in rows for v in r)
        self.rows = np.array(rows, np.int64 if small else object).reshape(len(rows), -1)
        sums = [sum(r) for r in rows]
        self.order = np.array(sorted(range(len(rows)), key=lambda i: (sums[i], i)), np.int64)
        self.sums = np.array([sums[i] for i in self.order], self.rows.dtype)
        self.deviations = deviations(self.rows)[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, squared distance) of the nearest centroid of each row of ``x``, ties to the smaller number; and how
        many distances were computed."""
        rows, devs = self.rows, self.deviations
        if x.dtype == object or rows.dtype == object:
            x, rows, devs = x.astype(object), rows.astype(object), np.zeros(len(devs))
        n, width, k = len(x), x.shape[1], len(rows)
        s, dev = x.sum(axis=1), deviations(x)
        right = np.searchsorted(self.sums, s)
        left = right - 1
        best, number = np.full(n, -1, x.dtype), np.full(n, k, np.int64)
        active, computed = np.arange(n), 0
        for _ in range(k):
            lo, hi = left[active], right[active]
            far_lo = np.abs(s[active] - self.sums[np.maximum(lo, 0)])
            far_hi = np.abs(s[active] - self.sums[np.minimum(hi, k - 1)])
            take_left = (hi >= k) | ((lo >= 0) & (far_lo <= far_hi))
            at, far = np.where(take_left, lo, hi), np.where(take_left, far_lo, far_hi)
            left[active] -= take_left
            right[active] += ~take_left
            # By the mean: this centroid and all farther ones are out.
            open_ = (best[active] < 0) | (far * far <= width * best[active])
            active, at, far = active[open_], at[open_], far[open_]
            # By the deviation as well, with room for the roots' rounding.
            bound = far.astype(float) ** 2 + (dev[active] - devs[at]) ** 2
            near = (best[active] < 0) | ~(bound > width * best[active].astype(float) * (1 + 1e-9) + 1)
            i, c = active[near], self.order[at[near]]
            d = ((x[i] - rows[c]) ** 2).sum(axis=1)
            computed += len(i)
            better = (best[i] < 0) | (d < best[i]) | ((d == best[i]) & (c < number[i]))
            best[i[better]], number[i[better]] = d[better], c[better]
            if not len(active):
                break
        return number, best, computed


def deviations(x: np.ndarray) -> np.ndarray:
    """The root of width * squared distance from the vector of equal components; zeros, which reject nothing, of large ones."""
    if x.dtype == object or not len(x):
        return np.zeros(len(x))
    s = x.sum(axis=1)
    return np.sqrt((x.shape[1] * (x * x).sum(axis=1) - s * s).astype(float))


def _vectors(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return whole(batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _sums(centroids: list[list[int]], width: int):
    """A task's count and sums of components of each cluster that it has vectors of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Centroids(centroids)
        sums: dict[int, list] = {}
        for batch in batches:
            x = _vectors(batch, width)
            number, _, _ = index.nearest(x)
            for c in np.unique(number).tolist():
                mine = x[number == c]
                count, total = sums.get(c, (0, [0] * width))
                sums[c] = (count + len(mine), [a + int(b) for a, b in zip(total, mine.sum(axis=0), strict=True)])
        cells = [(c, n, d, *map(Decimal, divmod(v, HALF))) for c, (n, total) in sums.items() for d, v in enumerate(total)]
        columns = list(zip(*cells, strict=True)) or [()] * 5
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.decimal128(38), pa.decimal128(38))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["cluster", "n", "dim", "high", "low"])

    return run


def _assign(centroids: list[list[int]], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Centroids(centroids)
        for batch in batches:
            number, distance, _ = index.nearest(_vectors(batch, width))
            fits = [int(d) if d < 2**63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(number, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector, and the final centroids.

    Vectors of ``width`` finite components count, in steps of 1 / ``scale``; others (null, of another width, with a null,
    NaN or infinite component, or one so large that doubles beyond the range of floats must hold it) have no row. The
    first centroids are the ``k`` vectors with the least sha256 of ``seed:vec_id``; of repeated ids, or null ones (which
    count as empty text), the least vectors. Fewer than ``k`` vectors make fewer centroids; an empty table gives no rows.
    A round assigns each vector to its nearest centroid, the smaller number at a tie, and moves each centroid to the
    floor of the mean; one that no vector is nearest to stays. Repeated rows count as often as they are there. Distance
    is null if it takes more than 64 bits. Other columns are not looked at.

    A round reads the written vectors once; a task gives one sum for each centroid and component, and Spark adds them.
    Only these k * width sums reach the driver.
    """
    rows = written(quantised(vectors, width=width, scale=scale), "vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    # Whole doubles become integers on the driver; k rows are all that are taken.
    centroids = [[int(v) for v in r.x] for r in rows.orderBy(first, "x").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        parts = rows.mapInArrow(_sums(centroids, width), "cluster int, n long, dim int, high decimal(38,0), low decimal(38,0)")
        for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect():
            centroids[r.cluster][r.dim] = (int(r.high) * HALF + int(r.low)) // r.n
    if not centroids:  # there are no vectors either
        return rows.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    return rows.mapInArrow(_assign(centroids, width), "vec_id long, cluster int, distance long"), centroids


def with_inertia(assigned: DataFrame) -> DataFrame:
    """Add cluster_inertia and inertia, the distances summed over a cluster and over all; null beyond 64 bits."""
    assigned = written(assigned, "assigned")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    each = assigned.groupBy("cluster").agg(total.alias("cluster_inertia"))
    every = each.agg(F.when(F.count("cluster_inertia") == F.count(F.lit(1)), F.sum("cluster_inertia")).alias("inertia"))
    sums = each.join(F.broadcast(every)).select("cluster", F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"), F.col("inertia").try_cast("long").alias("inertia"))  # one row
    return assigned.join(F.broadcast(sums), "cluster")  # one row a centroid
