"""Hard negatives against brute force, bounds of cells against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpen.llm import exact, multiindex

KIND = "vec_id long, label int, embedding array<double>, cell long, n int"


def brute(rows, is_anchor, positives=5, negatives=3):
    own = [(i, lab, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v]) for i, lab, v, *_ in rows
           if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    out = []
    for i, lab, v in {(i, lab, tuple(v)) for i, lab, v in own if is_anchor(i)}:
        others = sorted((-score(v, w), j, m) for j, m, w in own if j != i)
        for p, j, _ in [o for o in others if o[2] == lab][:positives]:
            inside = [(s, k) for s, k, m in others if m != lab and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    got = multiindex.mine(df, "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def is_anchor(i):
    return i % 50 == 0


def vectors(seed, n, width, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, int(rng.integers(labels)), (centres[rng.integers(6)] + 0.3 * rng.normal(size=width)).tolist(), 1, 2) for i in range(n)]


@pytest.mark.parametrize("first, chunk, block", [(8192, 2048, 256), (20, 16, 3)])
def test_against_brute_force(spark, monkeypatch, first, chunk, block):
    """With small limits there are many rounds, chunks and blocks."""
    for name, value in (("FIRST_ROWS", first), ("CHUNK_ROWS", chunk), ("BLOCK_ROWS", block), ("GROWTH", 3)):
        monkeypatch.setattr(multiindex, name, value)
    rows = vectors(1, 600, 8)
    assert mined(spark, rows) == brute(rows, is_anchor)


def test_odd_tables(spark):
    """Nulls, non-finite and huge components, other lengths, ties, repeated rows and anchors, a hot vector."""
    rng = random.Random(2)
    rows = vectors(3, 120, 3)
    rows += [(None, 1, [1.0], 0, 0), (200, None, [1.0], 0, 0), (201, 1, None, 0, 0), (202, 1, [1.0, None], 0, 0), (203, 0, [float("nan")], 0, 0), (204, 0, [float("inf")], 0, 0)]
    rows += [(50, 2, [0.5, 0.25], 0, 0), (250, 1, [], 0, 0), (300, 1, [2.0, 2.0, 2.0, 2.0], 0, 0)] + rows[:10] + rows[50:51]
    rows += [(1000 + 7 * i, rng.choice([0, 1]), [1.0, 1.0, 1.0], 0, 0) for i in range(150)]
    rows += [(5000, 1, [3e5, 0.0, 1.0], 0, 0), (5001, 1, [3.1e5, 0.0, 1.0], 0, 0), (5002, 0, [2.9e5, 1.0, 0.0], 0, 0)]
    assert mined(spark, rows) == brute(rows, is_anchor)


def test_wide_scores(spark):
    """Components beyond doubles' whole numbers are exact; what does not fit a long fails."""
    rows = [(0, 1, [2.0**40, 1.0], 0, 0), (1, 1, [2.0**6, 3.0], 0, 0), (2, 2, [2.0**5 + 0.5, 7.0], 0, 0), (3, 2, [2.0**5, 1.0], 0, 0)]
    got = mined(spark, rows)
    assert got == brute(rows, is_anchor) and got[0][4] > 2**53
    with pytest.raises(Exception, match="does not fit"):
        mined(spark, [(0, 1, [1e300], 0, 0), (1, 1, [1e290], 0, 0)])


def test_few_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], 0, 0)]) == []
    assert mined(spark, [(0, 1, [1.0], 0, 0)]) == []
    lone = [(0, 1, [1.0], 0, 0), (1, 2, [0.9], 0, 0), (2, 1, [-1.0], 0, 0)]
    assert mined(spark, lone) == brute(lone, is_anchor) == []


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(400, 6)))
    halves = [multiindex.fitted(part, 5) for part in (x[:, :3], x[:, 3:])]
    codes = multiindex.Codes(halves, None, None)
    at = [multiindex.nearest(p, c) for p, c in zip(codes.parts(x), halves)]
    away = [np.sqrt(((p - c[i]) ** 2).sum(1)) for p, c, i in zip(codes.parts(x), halves, at)]
    codes.radii = [np.array([a[i == k].max(initial=0) for k in range(len(c))]) for a, i, c in zip(away, at, halves)]
    first, second = codes.bounds(x[:20])
    bound = first[:, at[0]] + second[:, at[1]]
    assert (x[:20] @ x.T <= bound).all()
    seen = list(multiindex.visits(first[0], second[0]))
    assert len({(i, j) for _, i, j in seen}) == len(seen) == len(first[0]) * len(second[0])
    assert all(a[0] >= b[0] for a, b in zip(seen, seen[1:])) and all(b == first[0][i] + second[0][j] for b, i, j in seen)


def test_exact_products():
    x = exact.floored(np.array([[1.5, -0.25], [2.0**60, 1.0], [1e308, -3.0]]), 1024)
    assert x.dtype == object and x[0].tolist() == [1536, -256] and x[2].tolist() == [int(1e308) * 1024, -3072]
    assert exact.products(x, x)[1].tolist() == [1536 * 2**70 - 256 * 1024, 2**140 + 2**20, 2**70 * 1024 * int(1e308) - 3 * 2**20]
    y = exact.floored(np.array([[2.0**40, 3.0]]), 1024)
    z = exact.floored(np.array([[2.0**2, 1.0]]), 1024)
    assert exact.products(y, z).tolist() == [[2**62 + 3 * 2**20]] and exact.products(z, z).dtype == np.int64
    assert exact.best(np.array([5, 7, 7, 1]), np.array([1, 9, 2, 3]), 2).tolist() == [2, 1]
    assert exact.best(np.array([5, 2**80, 2**80], object), np.array([1, 9, 2]), 2).tolist() == [2, 1]
