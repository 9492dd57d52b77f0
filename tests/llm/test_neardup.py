"""Near duplicates against all pairs, sketches against their formula, odd tables."""

import re

import numpy as np
import pytest

from redpen.llm import neardup
from redpen.llm.components import components
from redpen.llm.queries import op1_odd_sketch_dedup


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain(texts):
    """id -> (set size, smallest reachable id) over all pairs of sets that share a shingle."""
    sets = {i: shingles(t) for i, t in texts.items()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in sets.items():
        common = {}
        for x in s:
            for j in holders[x]:
                if j > i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def answer(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_all_pairs(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    rows = op1_odd_sketch_dedup(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == len(texts)
    assert answer(rows) == plain(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_chains_shared_passages_and_copies(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 4))
    texts, i = {}, 1000
    for _ in range(12):  # drifting chains: neighbours are close, ends are not
        base = [word() for _ in range(120)]
        for _ in range(9):
            base[rng.integers(0, 120)] = word()
            base[rng.integers(0, 120)] = word()
            texts[i := i - 3] = " ".join(base)
    passage = [word() for _ in range(60)]
    for _ in range(150):  # half of each text is one passage
        texts[i := i - 3] = " ".join([*passage, *[word() for _ in range(int(rng.integers(10, 60)))]])
    for _ in range(80):  # copies
        texts[i := i - 3] = "Same text AGAIN and again and once more"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert answer(neardup.near_duplicates(docs, "doc_id", "text").collect()) == plain(texts)


def test_sketch_tells_similarity():
    rng = np.random.default_rng(1)
    multipliers = neardup._multipliers()
    for share in (0.6, 0.75, 0.9, 0.97):
        guesses = []
        for _ in range(40):
            n = 400
            both = int(round(n * 2 * share / (1 + share)))
            pool = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            x, y = (neardup.odd_sketch(neardup.min_hashes(s, multipliers)) for s in (a, b))
            z = int(np.bitwise_count(x ^ y).sum())
            guesses.append(1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(max(1 - 2 * z / neardup.BITS, 1e-3)))
        assert np.mean(guesses) == pytest.approx(share, abs=0.03)
        assert np.std(guesses) < 0.07


def test_pairs_at_the_limit_pass_the_sketches(spark):
    rng = np.random.default_rng(9)
    multipliers = neardup._multipliers()
    rows = []
    for size in [1, 2, 4, 7, 30, 63, 64, 65, 400, 1000, 5000] * 12:
        other = int(rng.integers(-(-3 * size // 4), size + 1))
        both = -(-3 * (size + other) // 7)  # the smallest intersection that links
        if both > other:
            continue
        pool = rng.integers(0, 2**63, size + other, dtype=np.uint64)
        pair = [pool[:size], np.concatenate([pool[:both], pool[size : size + other - both]])]
        rows.append([
            (len(s), *(x.view(np.int64).tolist() for x in (neardup.odd_sketch(neardup.min_hashes(s, multipliers)), *neardup.whole_sketch(s)))) for s in pair
        ])
    kind = "struct<n_shingles: long, sketch: array<long>, whole: array<long>, half: array<long>>"
    frame = spark.createDataFrame(rows, f"a {kind}, b {kind}")
    assert len(rows) > 80 and frame.filter(neardup.may_link(frame["a"], frame["b"])).count() == len(rows)


def test_odd_tables(spark):
    cols = "doc_id long, text string, n_shingles int, component_id string, rep int, band int"
    rows = [(5, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  b"), (9, "a b"), (10, "b a"), (None, "a b"), (None, None), (11, "w " * 150_000), (12, "w " * 160_000)]
    docs = spark.createDataFrame([(*r, 1, "x", 1, 1) for r in rows], cols)
    got = sorted(((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, "doc_id", "text").collect()), key=str)
    want = [
        (-1, 0, None, True), (-1, 1, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False),
        (9, 1, 8, False), (10, 1, 10, True), (11, 1, 11, True), (12, 1, 11, False),
    ]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(docs.limit(0), "doc_id", "text").collect() == []


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2300)]
    links += [(5, None), (7, 7)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
