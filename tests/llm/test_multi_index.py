"""Hard negatives of the inverted multi-index against scoring every pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fibrelens.llm import multi_index
from fibrelens.llm.multi_index import Index

DDL = "vec_id long, embedding array<float>, label int, code string, block string, score string, rank string"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, c, "x", "x", "x", "x") for i, v, c in rows], DDL.replace("float", kind))


def brute(rows, every, k=5, least=80):
    good = {}
    for i, v, c in rows:
        if i is None or v is None or c is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        code = [min(max(math.floor(256 * x), LOW), HIGH) for x in v]
        good[i] = min(good.get(i, (c, code)), (c, code))
    width = max((len(v) for _, v in good.values()), default=0)
    good = {i: (c, v + [0] * (width - len(v))) for i, (c, v) in good.items()}
    out = []
    for a, (label, q) in good.items():
        if a % every:
            continue
        met = [(min(max(sum(x * y for x, y in zip(q, v)), LOW), HIGH), i, c) for i, (c, v) in good.items() if i != a]
        met.sort(key=lambda m: (-m[0], m[1]))
        for p, i, _ in [m for m in met if m[2] == label][:k]:
            window = [m for m in met if m[2] != label and least * p <= 100 * m[0] <= 100 * p][:k]
            out += [(a, i, rank, j, p, s) for rank, (s, j, _) in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows, every, kind="float", **given):
    taken = multi_index.labelled_vectors(frame(spark, rows, kind))
    got = multi_index.hard_negatives(taken, F.col("vec_id") % every == 0, **given)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(n, width, seed, groups=8, noise=0.1):
    chance = np.random.default_rng(seed)
    centres = chance.normal(size=(groups, width))
    points = (centres[chance.integers(groups, size=n)] + noise * chance.normal(size=(n, width))).astype(np.float32)
    return [(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(points, chance.integers(3, size=n)))]


@pytest.mark.parametrize("first_rows", [40, 1 << 14])
def test_equals_scoring_all_pairs(spark, monkeypatch, first_rows):
    monkeypatch.setattr(multi_index, "CELL", 20)
    monkeypatch.setattr(multi_index, "CHUNK", 16)
    monkeypatch.setattr(multi_index, "BLOCK", 3)
    rows = clustered(500, 6, 1)
    # A third of all rows is one vector with several labels: ties, and a hot cell of many chunks.
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(250)]
    assert found(spark, rows, 25, first_rows=first_rows) == brute(rows, 25)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "CELL", 4)
    rows = clustered(60, 4, 2)
    rows += [(100, None, 1), (110, [1.0, None, 0.0, 0.0], 1), (120, [math.nan] * 4, 1), (130, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(140, [0.5] * 4, None), (None, [0.5] * 4, 1), (150, [], 1), (160, [0.3], 2), (170, [0.1] * 6, 0), (5, rows[5][1], rows[5][2])]
    rows += [(10, [9.0] * 4, 7), (10, [0.25] * 4, 0)]  # an id that repeats with other values
    assert found(spark, rows, 10) == brute(rows, 10)


def test_numbers_beyond_a_double_are_exact(spark):
    chance = np.random.default_rng(3)
    rows = [(i, [float(x) for x in chance.integers(1, 1 << 40, 3)], int(i % 2)) for i in range(30)]
    rows += [(50, [1e300, -1e300, 0.0], 0), (60, [1e300, 1.0, 1.0], 1), (70, [-1e300, 1.0, 1.0], 1)]
    assert found(spark, rows, 10, kind="double") == brute(rows, 10)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [], 1), (1, [], 1), (2, [], 2)], [(0, None, None)]])
def test_small_tables(spark, rows):
    assert found(spark, rows, 100) == brute(rows, 100)


def made_index(points, k, cell_rows=None):
    halves = multi_index._halves(points)
    books = tuple(multi_index._means(h, k) for h in halves)
    (c1, d1), (c2, d2) = (multi_index._nearest(h, b) for h, b in zip(halves, books))
    radii = tuple(np.array([d[c == i].max(initial=0) for i in range(k)]) for c, d in ((c1, d1), (c2, d2)))
    grid = np.zeros((k, k), np.int64)
    np.add.at(grid, (c1, c2), 1)
    return Index(books, radii, grid, "<i8", True, 64), c1, c2


def test_cells_come_once_and_by_falling_bound_and_bounds_hold():
    points = np.random.default_rng(4).integers(-200, 200, (400, 7))
    index, c1, c2 = made_index(points, 9)
    for query in points[:20]:
        upper = multi_index.bounds(query, index)
        seen = list(multi_index.cells_by_bound(upper))
        assert len({(i, j) for _, i, j in seen}) == len(seen) == 81
        assert all(a[0] >= b[0] for a, b in zip(seen, seen[1:]))
        assert (points @ query <= upper[0][c1] + upper[1][c2]).all()


def test_windows_are_certified_before_all_cells_are_read():
    rows = clustered(4000, 8, 5, groups=40, noise=0.02)
    points = np.floor(256 * np.array([v for _, v, _ in rows])).astype(np.int64)
    index, _, _ = made_index(points, 12)
    block = []
    for at in range(0, 4000, 400):
        met = np.sort(np.delete(points @ points[at], at))[::-1]
        block.append({"anchor_id": at, "label": 0, "code": points[at].tobytes(), "popped": 0, "slots": [{"slot": 0, "high": HIGH, "need": int(met[4])}]})
    parts = list(multi_index._walk_block(block, index, 1 << 30))
    met = sum(index.rows[r["c1"], r["c2"]] * np.frombuffer(r["queries"], np.int64, 1)[0] for p in parts for r in p.to_pylist() if r["chunk"] == 0)
    assert met < 4000 * len(block) / 4
