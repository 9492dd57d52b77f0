"""Quality: the model against plain dictionaries, normalisation, held-out separation, odd tables."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from redpen.llm import quality
from redpen.llm.queries import op2_kneser_ney_quality

TEXTS = ["the cat sat on the mat", "the cat sat", "a dog sat on the mat", "the dog ran", "the cat ran on", "a cat sat on a mat", "", "x", "the the the", "a b a b a b"] * 2 + [
    "the cat sat on the red mat", "one more line", "dog dog cat", "on the mat sat the cat"
]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def plain_model(texts):
    """Interpolated modified Kneser-Ney with pruned singletons, by dictionaries."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *words(t), "</s>"]
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter(t[1:] for t in tri)
    uni = Counter(b[1] for b in bi)

    def discounts(counts):
        n = Counter(counts.values())
        if not (n[1] and n[2] and n[3] and n[4]):
            return [0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)]

    def weights(counts):
        by, totals, alpha, gamma = discounts(counts), Counter(), {}, defaultdict(lambda: 1.0)
        for key, n in counts.items():
            totals[key[:-1]] += n
        for key, n in counts.items():
            if n > 1:
                alpha[key] = (n - by[min(n, 3) - 1]) / totals[key[:-1]]
                gamma[key[:-1]] -= alpha[key]
        return alpha, gamma

    a3, g3 = weights(tri)
    a2, g2 = weights(bi)
    by, total = discounts(uni), sum(uni.values())
    unknown = sum(by[min(n, 3) - 1] for n in uni.values()) / total / (len(uni) + 1)

    def chance(first, before, word):
        a1 = (uni[word] - by[min(uni[word], 3) - 1]) / total + unknown if word in uni else unknown
        return a3.get((first, before, word), 0) + g3[first, before] * (a2.get((before, word), 0) + g2[(before,)] * a1)

    return chance, uni


def test_model_against_dictionaries(spark):
    model = quality.fit(spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string"), "t")
    chance, uni = plain_model([*TEXTS, None])
    queries = ["the cat sat on the mat", "The dog sat on a new mat", "", "zzz yyy", "a b a b the cat", "on the red mat"]
    logs, sizes = quality.log_chances(model.lookups(), queries)
    for q, log, n in zip(queries, logs, sizes):
        w = ["<s>", "<s>", *words(q), "</s>"]
        assert n == len(w) - 2
        assert log == pytest.approx(sum(math.log10(chance(*x)) for x in zip(w, w[1:], w[2:])), abs=1e-9)
    for context in (("the", "cat"), ("<s>", "<s>"), ("zzz", "the"), ("a", "b")):
        assert sum(chance(*context, w) for w in uni) + chance(*context, "never seen") == pytest.approx(1, abs=1e-9)


def test_labels_are_told_apart(spark):
    sf = "/root/testdata/sf0.1"
    found = op2_kneser_ney_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rates = dict(found.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect())
    assert rates[1] > 0.99 and rates[0] < 0.35


def test_odd_tables(spark):
    cols = "doc_id long, text string, lang string, kept int, _text string, _lang int"
    rows = [(i, t, "en" if i % 2 else None, 1, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", "fr", 1, "x", 1), (1, None, "en", 1, "x", 1), (1, None, "en", 1, "x", 1), (70, "q " * 200_000, "en", None, None, None)]
    docs = spark.createDataFrame(rows, cols)
    trusted = spark.createDataFrame([(i,) for i in range(12)] + [(None,), (999,)], "doc_id long")
    got = quality.classify(docs, trusted, "doc_id", "text", "lang").collect()
    assert len(got) == len(rows)
    assert all(not r["kept"] and r["perplexity"] is None for r in got if not r["n_tokens"])
    assert quality.classify(docs.limit(0), trusted, "doc_id", "text", "lang").collect() == []
    nobody = quality.classify(docs, trusted.limit(0), "doc_id", "text", "lang").collect()
    assert all(r["kept"] == (r["n_tokens"] > 0) for r in nobody)


def test_limits_are_quantiles_of_all_that_was_not_trained_on(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_ROWS", 40)
    texts = [f"the cat {'sat ' * (i % 7)}on {i % 13} mat {i % 5} and {i % 3}" for i in range(400)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = docs.select("doc_id")
    chosen, others = quality.trusted_rows(docs, trusted, "doc_id", "text", "lang")
    assert chosen.count() <= 40 and chosen.count() + others.count() == 400
    judge, scores = quality.learn(docs, trusted, "doc_id", "text", "lang")
    median, limit = judge.limits["en"]
    unseen = scores.join(others, "_id", "left_semi").collect()
    means = sorted((median * quality.PRIOR_WORDS - r["_log"]) / (r["_n"] + quality.PRIOR_WORDS) for r in unseen)
    assert limit in [pytest.approx(m) for m in means]
    assert sum(m <= limit + 1e-9 for m in means) / len(means) >= quality.QUANTILE


def test_all_trusted_text_counts(spark):
    texts = [f"the cat {'sat ' * (i % 7)}on {i % 13} mat {i % 5} and {i % 3}" for i in range(10_000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(8)
    chosen, others = quality.trusted_rows(docs, docs.select("doc_id"), "doc_id", "text", "lang")
    assert chosen.count() > 4_800 and chosen.count() + others.count() == 10_000


def test_weights_of_any_number_give_the_same_scores(spark, monkeypatch):
    rows = [(i, t, "en") for i, t in enumerate([*TEXTS, "The dog sat on a new mat", "zzz yyy", None, "on the red mat"])]
    docs = spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, text string, lang string").repartition(3)

    def logs(model):
        return sorted((r["_id"], round(r["_log"], 9), r["_n"]) for r in quality.scored(docs, "doc_id", "text", "lang", model).collect())

    whole = quality.fit(docs.filter("doc_id < 24"), "text")
    assert whole.rest is None
    expected = logs(whole)
    monkeypatch.setattr(quality, "FILTER_BITS", 1 << 10)
    for head in (0, 5, 20):
        monkeypatch.setattr(quality, "HEAD", head)
        assert logs(quality.fit(docs.filter("doc_id < 24"), "text")) == expected


def test_filter_lets_few_other_keys_through(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILTER_BITS", 1 << 16)
    table = spark.range(5_000).select(F.xxhash64("id").alias("key"))
    bits = quality._key_bits(table)
    inside = table.toArrow()["key"].to_numpy().view("uint64")
    others = spark.range(5_000, 55_000).select(F.xxhash64("id").alias("key")).toArrow()["key"].to_numpy().view("uint64")
    assert len(quality._maybe(bits, inside)) == 5_000
    assert len(quality._maybe(bits, others)) < 0.01 * 50_000


def plain_whole_model(texts):
    """Interpolated modified Kneser-Ney of all sequences, by dictionaries."""
    tri = Counter()
    for t in texts:
        w = ["<s>", "<s>", *words(t), "</s>"]
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter(t[1:] for t in tri)
    uni = Counter(b[1] for b in bi)

    def shares(counts):
        n, totals = Counter(counts.values()), Counter()
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        enough = n[1] and n[2] and n[3] and n[4]
        found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]] if enough else [0.5, 1.0, 1.5]
        by = [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)] if enough else found
        for key, c in counts.items():
            totals[key[:-1]] += c
        alpha = {key: (c - by[min(c, 3) - 1]) / totals[key[:-1]] for key, c in counts.items()}
        left = defaultdict(lambda: 1.0)
        for key, a in alpha.items():
            left[key[:-1]] -= a
        return alpha, left

    a3, g3 = shares(tri)
    a2, g2 = shares(bi)
    a1, g1 = shares({(w,): c for w, c in uni.items()})
    unknown = g1[()] / (len(uni) + 1)

    def chance(first, before, word):
        p1 = a1.get((word,), 0) + unknown
        return a3.get((first, before, word), 0) + g3[first, before] * (a2.get((before, word), 0) + g2[(before,)] * p1)

    return chance, uni


@pytest.mark.parametrize("head", [None, 0, 9])
def test_sequences_seen_once_have_weights(spark, monkeypatch, head):
    texts = [*TEXTS, "seen only once here", None]
    if head is not None:
        monkeypatch.setattr(quality, "HEAD", head)
    trusted = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    queries = ["the cat sat on the mat", "seen only once here", "only once seen", "on the red mat", "zzz once here", "", "a b a b the cat"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(queries)], "doc_id long, text string, lang string")
    got = {r["_id"]: r for r in quality.scored(docs, "doc_id", "text", "lang", quality.fit(trusted, "t", least=1)).collect()}
    chance, uni = plain_whole_model(texts)
    for i, q in enumerate(queries):
        w = ["<s>", "<s>", *words(q), "</s>"]
        assert got[i]["_log"] == pytest.approx(sum(math.log10(chance(*x)) for x in zip(w, w[1:], w[2:])), abs=1e-9)
    for context in (("only", "once"), ("<s>", "<s>"), ("zzz", "the"), ("a", "b")):
        assert sum(chance(*context, w) for w in uni) + chance(*context, "never seen") == pytest.approx(1, abs=1e-9)


def test_the_judge_learns_from_sequences_seen_once(spark):
    docs = spark.createDataFrame([(i, f"one{i} two{i} three{i}", "en") for i in range(60)], "doc_id long, text string, lang string")
    trusted = docs.select("doc_id")
    chosen, _ = quality.trusted_rows(docs, trusted, "doc_id", "text", "lang")
    taught = [r["_id"] for r in chosen.collect()]
    chance, _ = plain_whole_model([f"one{i} two{i} three{i}" for i in taught])
    scores = {r["_id"]: r["_log"] for r in quality.learn(docs, trusted, "doc_id", "text", "lang")[1].collect()}
    for i in taught:
        w = ["<s>", "<s>", f"one{i}", f"two{i}", f"three{i}", "</s>"]
        assert scores[i] == pytest.approx(sum(math.log10(chance(*x)) for x in zip(w, w[1:], w[2:])), abs=1e-9)
