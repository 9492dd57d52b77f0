"""Exact top-k against brute force, whatever the size of the components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpen.llm import topk

KIND = "vec_id long, embedding array<double>, score string, rank int"


def scaled(x, scale=1024):
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def brute(rows, k=10):
    own = [(i, tuple(scaled(x) for x in v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, v) for i, v in own if i % 100 == 0}:
        best = sorted((-sum(x * y for x, y in zip(v, w)), j) for j, w in own if j != q)[:k]
        out += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, k=10):
    got = topk.top_k(spark.createDataFrame(rows, KIND), "vec_id", "embedding", F.col("vec_id") % 100 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("chunk, block", [(8192, 256), (50, 3)])
def test_against_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(topk, "QUERY_ROWS", block)
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=20).tolist(), "", 0) for i in range(700)]
    assert found(spark, rows) == brute(rows)


def test_odd_tables(spark):
    """Nulls, non-finite components, ties, repeated rows and queries, other lengths, a hot vector, negative ids."""
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.0, 0.5, -1.0]) for _ in range(rng.randint(0, 4))], "x", 1) for i in range(-200, 200)]
    rows += [(None, [1.0], "", 0), (300, None, "", 0), (301, [None, 1.0], "", 0), (302, [float("nan")], "", 0), (303, [float("-inf")], "", 0)]
    rows += [(400 + i, [1.0, 1.0], "", 0) for i in range(200)] + rows[:5] + [rows[0], (100, [0.25], "", 0), (7, [2.0], "", 0)]
    assert found(spark, rows) == brute(rows)


def test_large_components(spark):
    """Components of any size stay queries and candidates, next to small ones."""
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(3)], "", 0) for i in range(120)]
    rows += [(1000, [3e5, 1.0, 0.0], "", 0), (1001, [-3e5, 2.0, 1.0], "", 0), (1002, [2.0**23, -1.5, 0.0], "", 0), (1003, [0.0, 0.0, 262144.0], "", 0)]
    assert found(spark, rows) == brute(rows)
    both = [(0, [2.0**40, 1.0], "", 0), (1, [2.0**2, 1.0], "", 0), (2, [2.0**2 + 2.0**-10, 0.0], "", 0)]
    assert found(spark, both) == brute(both)
    with pytest.raises(Exception, match="does not fit"):
        found(spark, [(0, [1e300], "", 0), (1, [1e300], "", 0)])
    longer = [(i, [rng.choice([2.6e5, -2.6e5, 1.0]) for _ in range(300)], "", 0) for i in range(30)]
    assert found(spark, longer) == brute(longer)


def test_few_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], "", 0)]) == []
    assert found(spark, [(1, [1.0], "", 0), (100, [2.0], "", 0)]) == [(100, 1, 1, 2048 * 1024)]
