"""Item factors against a small dense implicit ALS."""

import numpy as np

from millrace.operators import jobs
from millrace.plans import queries


def solve(r: np.ndarray, y: np.ndarray, reg: float = 0.8, alpha: float = 150.0) -> np.ndarray:
    """The other side's factors, with the penalty scaled by each row's number of ratings."""
    out = np.zeros((len(r), y.shape[1]))
    for i, row in enumerate(r):
        c = alpha * row
        a = y.T @ y + (y.T * c) @ y + reg * (row > 0).sum() * np.eye(y.shape[1])
        out[i] = np.linalg.solve(a, y.T @ ((1 + c) * (row > 0)))
    return out


def loss(r: np.ndarray, y: np.ndarray, reg: float = 0.8, alpha: float = 150.0) -> float:
    x = solve(r, y)
    rated = r > 0
    fit = ((1 + alpha * r) * (rated - x @ y.T) ** 2).sum()
    return float(fit + reg * ((rated.sum(1) * (x**2).sum(1)).sum() + (rated.sum(0) * (y**2).sum(1)).sum()))


def test_item_factors_lie_near_a_dense_solution(spark):
    r = np.zeros((12, 8))
    for u in range(12):
        for i in range(8):
            if (u % 3 == i % 3) or (u * 5 + i) % 11 == 0:
                r[u, i] = 1 + (u + i) % 3
    rows = [(int(u), int(i), float(r[u, i])) for u, i in zip(*np.nonzero(r), strict=True)]
    got = {x.id: np.array(x.factors.split(","), float) for x in jobs.item_factors(spark.createDataFrame(rows, "user int, item int, rating float")).collect()}
    assert set(got) == set(range(8)) and all(len(v) == 40 for v in got.values())

    def dense(iterations: int) -> float:
        x = np.random.default_rng(0).normal(size=(12, 40))
        y = solve(r.T, x / np.linalg.norm(x, axis=1, keepdims=True))
        for _ in range(iterations - 1):
            y = solve(r.T, solve(r, y))
        return loss(r, y)

    # The start decides how far twenty iterations get: between the dense loss of three and that at convergence.
    found = loss(r, np.array([got[i] for i in range(8)]))
    assert 0.99 * dense(200) < found < 0.9 * dense(3), found


def test_registered_item_factors_use_the_defaults(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "item_factors", lambda ratings, **options: seen.append(options) or ratings)
    queries.QUERIES["f8_item_factors"](spark, sf)
    assert seen == [{}]
