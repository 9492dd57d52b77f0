"""Near vectors against all pairs, on the tables and on made clusters; odd tables."""

import numpy as np
import pytest

from redpen.llm import vectorgraph as vg
from redpen.llm.queries import op6_pruned_graph


def plain(vectors):
    """id -> (links, smallest reachable id) over all pairs in double precision."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    np.fill_diagonal(close, False)
    label = np.arange(len(ids))
    while True:
        after = np.minimum(label, np.where(close, label[None, :], len(ids)).min(1))
        if np.array_equal(after, label):
            return {i: (int(close[k].sum()), ids[label[k]]) for k, i in enumerate(ids)}
        label = after


def answer(rows):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_all_pairs(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()}
    assert answer(op6_pruned_graph(spark, f"/root/testdata/{sf}").collect()) == plain(vectors)


def test_crowded_place(spark, monkeypatch):
    monkeypatch.setattr(vg, "SHARD_ROWS", 128)  # the crowd needs many parts
    rng = np.random.default_rng(2)
    middle = rng.normal(size=32)
    crowd = {i: middle + rng.normal(size=32) * 0.16 for i in range(900)}
    rest = {i: rng.normal(size=32) for i in range(900, 2000)}
    vectors = crowd | rest
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got, want = answer(vg.near_vectors(docs, "vec_id", "embedding").collect()), plain(vectors)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert 0.98 * there <= found <= there
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_odd_tables(spark):
    cols = "vec_id long, embedding array<float>, label int, rep string, held int, component string"
    nan, inf = float("nan"), float("inf")
    rows = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (None, [1.0, 0.0]), (10, [1.0])]
    docs = spark.createDataFrame([(*r, 1, "x", 1, "x") for r in rows], cols)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vg.near_vectors(docs, "vec_id", "embedding").collect()), key=str)
    want = [(3, 3, 1, False), (3, 3, 1, False), (1, 3, 1, True), (10, 3, 1, False), (None, 0, None, True)]
    want += [(i, 0, i, True) for i in (2, 4, 5, 6, 7, 8, 9)]
    assert got == sorted(want, key=str)
    assert vg.near_vectors(docs.limit(0), "vec_id", "embedding").collect() == []
