"""Top-k against all scores."""

import random

import pytest
from pyspark.sql import functions as F

from marketlake.llm import pivots


def brute(rows, k):
    fine = [(i, [int((x * 64) // 1) for x in v]) for i, v in rows
            if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    out = []
    for q, a in fine:
        if q is not None and q % 20 == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), i is None, i or 0, i) for i, b in fine if i != q]
            out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1)]
    return sorted(out, key=str)


def got(spark, rows, k=20, **options):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, v int").repartition(3)
    found = pivots.top_k(pivots.scaled(table), F.col("vec_id") % 20 == 0, k, **options)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, found.collect()), key=str)


r = random.Random(1)
nan, inf = float("nan"), float("inf")
CASES = {
    "none": [], "one": [(0, [1.0, 2.0])], "few": [(i, [0.5 * i, 1.0]) for i in range(5)],
    "odd": [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [-inf, 0.0]), (None, [3.0, 3.0]),
            (7, [0.0, 0.0]), (20, [-1.0, -0.001]), (40, [])],
    "hot": [(i, [0.25, -0.5, 0.125] if i % 3 else [r.gauss(0, 1) for _ in range(3)]) for i in range(300)],
    "random": [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(600)],
    "norms": [(i, [r.gauss(0, 1) * (1 + i % 50) for _ in range(4)]) for i in range(400)],
}


@pytest.mark.parametrize("case", CASES)
def test_against_all_scores(spark, case, monkeypatch):
    monkeypatch.setattr(pivots, "QUERIES", 8)
    rows = [(i, None if v is None else [None if x is None else __import__("numpy").float32(x).item() for x in v]) for i, v in CASES[case]]
    assert got(spark, rows, block=128) == brute(rows, 20)
    assert got(spark, rows, k=3, pivots=1) == brute(rows, 3)


def test_bounds_save_evaluations():
    """Clustered points: most candidates are never looked at."""
    import numpy as np

    g = np.random.default_rng(2)
    points = np.repeat(g.integers(-500, 500, (40, 6)), 50, axis=0) + g.integers(-5, 5, (2_000, 6))
    longest = float((points**2).sum(axis=1).max())
    added = np.sqrt(longest - (points**2).sum(axis=1))
    table = pivots.choose_pivots(points[:500].astype(float), longest)
    query = points[7].astype(float)
    bounds = np.abs(pivots._distances(points.astype(float), added, table) - pivots._distances(query[None], np.zeros(1), table)).max(axis=1)
    true = (query**2).sum() + longest - 2 * points @ query
    assert (bounds**2 <= true + 1e-3).all()

    class Counting(np.ndarray):
        looked = 0

        def __getitem__(self, at):
            Counting.looked += len(at)
            return np.asarray(self)[at]

    scores, _ = pivots._best(query, -1, bounds**2, points.astype(float).view(Counting), np.arange(2_000), float((query**2).sum()) + longest, 20)
    assert sorted(scores) == sorted(np.sort(points @ query)[-20:])
    assert Counting.looked < 1_500


@pytest.mark.parametrize("size", [22, 26, 30, 40])
def test_norms_beyond_doubles(spark, size):
    """Components near 2**size: neighbours differ in the last digits of scores that doubles do not hold."""
    g = random.Random(size)
    top = 2**size
    rows = [(i, [top - g.randrange(8) for _ in range(5)]) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    if size == 40:  # squares near 2**82 are no 64-bit numbers: scores of both signs cancel
        rows = [(0, [top, top, 1]), *((i, [top - i, g.randrange(8) - top, 3]) for i in range(1, 20))]
        table = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = sorted(map(tuple, pivots.top_k(table, F.col("vec_id") % 20 == 0, 3, block=16).collect()))
    want = []
    for q, a in rows:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:3]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


@pytest.mark.parametrize("spread", [3, 500])
def test_steps_and_products_agree_with_all_scores(spread):
    """Both ways of evaluating, alone and mixed, for many queries at a time."""
    import numpy as np

    g = np.random.default_rng(spread)
    points = (np.repeat(g.integers(-500, 500, (30, 6)), 40, axis=0) + g.integers(-spread, spread, (1_200, 6)))
    longest = float((points**2).sum(axis=1).max())
    table = pivots.choose_pivots(points[:400].astype(float), longest)
    far = pivots._distances(points.astype(float), np.sqrt(longest - (points**2).sum(axis=1)), table)
    queries = points[::40].astype(float)
    bounds = np.abs(pivots._distances(queries, np.zeros(30), table)[:, None] - far[None]).max(axis=2)
    above = pivots._above(bounds, (queries**2).sum(axis=1) + longest)
    for query, (scores, at) in zip(queries, pivots._bests(queries, above, points.astype(float), np.arange(1_200), 10)):
        every = points @ query
        best = np.lexsort((np.arange(1_200), -every))[:10]
        assert at.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
