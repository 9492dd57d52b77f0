"""Mixing: the classifier and the rates against plain Python, held-out accuracy, odd tables."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from redpen.llm import mixing
from redpen.llm.queries import SHARES, op3_soft_mixing

SF = "/root/testdata/sf0.001"


def tokens(text):
    out = []
    for w in re.split(r"[\x20\x09-\x0d]+", text or ""):
        if w and all(c.isalpha() or c in ".," for c in w):
            out.append(w.lower())
        elif w:
            kinds = [next((new for kind, new in (("Ll", "a"), ("Lu", "A"), ("N", "0")) if unicodedata.category(c).startswith(kind)), c) for c in w]
            out.append("".join(k for i, k in enumerate(kinds) if not (i and k == kinds[i - 1] and k in "aA0")))
    return out


def features(text):
    """Different words and the tenths they make up."""
    words = tokens(text)
    return {*words, *([f"different/10: {len(set(words)) * 10 // len(words)}"] if len(words) >= mixing.VARIED else [])}


def hashes(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", mixing.bucket(F.col("w")).alias("b")).collect()
    return {r["w"]: r["b"] for r in rows}


def brute(spark, docs, labels, shares):
    """The same model and least squares with dictionaries and one matrix; docs: id -> text, labels: id -> domain."""
    domains = list(shares)
    at = hashes(spark, {w for t in docs.values() for w in features(t)})
    counts = {d: Counter() for d in domains}
    for i, d in labels.items():
        if i in docs:
            counts[d].update(at[w] for w in features(docs[i]))
    sizes = Counter(d for i, d in labels.items() if i in docs)
    every, weight = sum(sizes.values()), {}
    for b in set().union(*counts.values()):
        n = sum(counts[d][b] for d in domains)
        gap = max(abs(counts[d][b] - n * sizes[d] / every) / math.sqrt(n * sizes[d] / every + 1) for d in domains)
        logs = [math.log((counts[d][b] + mixing.SMOOTHING * n / every) / (sizes[d] + mixing.SMOOTHING)) for d in domains]
        if gap > mixing.SIGNIFICANT:
            weight[b] = logs
    prior = np.log(np.array([sizes[d] + 1.0 for d in domains]) / (every + len(domains)))
    ids, p, n = sorted(docs), [], []
    for i in ids:
        logit = prior + sum((np.array(weight[at[w]]) for w in features(docs[i]) if at[w] in weight), np.zeros(len(domains)))
        p.append(np.exp(logit - logit.max()) / np.exp(logit - logit.max()).sum())
        n.append(len(tokens(docs[i])))
    return ids, np.array(p), np.array(n)


@pytest.fixture(scope="module")
def found(spark):
    return {r["doc_id"]: r for r in op3_soft_mixing(spark, SF).collect()}


def test_posteriors_and_rates(spark, found):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["domain"] for r in mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    ids, p, n = brute(spark, docs, labels, SHARES)
    assert sorted(found) == ids
    for i, row, size in zip(ids, p, n):
        r = found[i]
        assert r["n_tokens"] == size
        assert [r[f"p_{d}"] for d in SHARES] == pytest.approx(row.tolist(), abs=1e-6)
    rate = np.array([found[i]["rate"] for i in ids])
    goal = np.array(list(SHARES.values())) * n.sum()
    held = (rate * n) @ p
    assert (rate >= 0).all()
    # plain projected gradient on the same objective, one rate per document, run much longer
    r, a = np.ones(len(ids)), p / np.sqrt(goal)
    step = 1 / (np.linalg.eigvalsh((a * n[:, None]).T @ a).max() + mixing.RIDGE)

    def objective(r):
        return (((r * n) @ a - np.sqrt(goal)) ** 2).sum() + mixing.RIDGE * (n * (r - 1) ** 2).sum()

    for _ in range(50_000):
        r = np.maximum(0, r - step * (a @ ((r * n) @ a - np.sqrt(goal)) + mixing.RIDGE * (r - 1)))
    assert objective(rate) <= objective(r) * (1 + 1e-3) + 1e-6


def test_unreachable_and_zero_targets(spark):
    members = spark.createDataFrame([(10, [1.0, 0.0]), (30, [1.0, 0.0])], "n_tokens long, p array<double>")
    rate, held = mixing.fit_rates(members, [80.0, 50.0])
    assert held == pytest.approx([80.0, 0.0], rel=2e-3)
    rate, held = mixing.fit_rates(members, [0.0, 5.0])
    assert [r[0] for r in members.select(rate).collect()] == pytest.approx([0.0, 0.0], abs=1e-3)
    rate, held = mixing.fit_rates(members.limit(0), [1.0, 5.0])
    assert held == [0.0, 0.0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = mixing.quality_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    taught = labels.filter(F.col("doc_id") % 2 == 0)
    got = mixing.mix_sources(docs, taught, "doc_id", "text", "domain", SHARES).join(labels.filter(F.col("doc_id") % 2 == 1), "doc_id")
    right = {d: got.filter(F.col("domain") == d).agg(F.avg((F.col(f"p_{d}") > 0.5).cast("int"))).first()[0] for d in SHARES}
    assert right["clean"] > 0.95 and right["poor"] > 0.6 and right["toxic"] > 0.6


def test_odd_tables(spark):
    cols = "doc_id long, text string, source string, bucket int, rate string, w string"
    rows = [(1, "a b", "s", 1, "x", "y"), (1, "a b", "s", 1, "x", "y"), (2, None, None, None, None, None), (None, "", "s", 1, "x", "y"), (3, "a " * 100_000, "s", 1, "", "")]
    labels = spark.createDataFrame([(1, "clean"), (1, "toxic"), (None, "poor"), (9, None), (3, "other")], "doc_id long, domain string")
    got = mixing.mix_sources(spark.createDataFrame(rows, cols), labels, "doc_id", "text", "domain", SHARES, ("source",)).collect()
    assert len(got) == 5 and sorted(r["n_tokens"] for r in got) == [0, 0, 2, 2, 100_000]
    assert len({(r["rate"], r["copies"]) for r in got if r["doc_id"] == 1}) == 1
    empty = mixing.mix_sources(spark.createDataFrame([], cols), labels.limit(0), "doc_id", "text", "domain", SHARES)
    assert empty.collect() == []


def test_only_native_operators(spark):
    plan = op3_soft_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
