"""Windows, spans and masked rows against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from redpen.functions import kernels
from redpen.operators import features, lookup, masked_lm, spans, windows


def brute_windows(n, room, stride):
    out, start = [], 0
    while start < n:
        length = min(n - start, room)
        out.append((start, length))
        if start + length == n:
            break
        start += min(length, stride)
    return out


@pytest.mark.parametrize("n, q, stride", [(0, 2, 4), (1, 2, 4), (7, 2, 4), (40, 2, 4), (41, 3, 5), (30, 9, 50), (33, 0, 1)])
def test_windows_and_context(spark, n, q, stride):
    max_len, max_query = 16, 6
    df = spark.createDataFrame([(1, ["d"] * n, ["q"] * q)], "doc_id bigint, doc_tokens array<string>, query_tokens array<string>")
    rows = windows.max_context(windows.doc_windows(df, max_len, stride, max_query)).orderBy("win").collect()
    expected = brute_windows(n, max_len - 3 - min(q, max_query), stride)
    assert [(r.start, r.length) for r in rows] == expected
    for at in range(n):
        scores = [
            (min(at - s, s + size - 1 - at) + 0.01 * size, -w) for w, (s, size) in enumerate(expected) if s <= at < s + size
        ]
        best = -max(scores)[1]
        assert [w for w, r in enumerate(rows) if r.start <= at < r.start + r.length and r.is_max_context[at - r.start]] == [best]


def test_align(spark):
    pieces = [["(", "1895", "-", "1943", ")", "."], ["x"]]
    df = spark.createDataFrame(
        [(pieces, 0, 0, ["1895"]), (pieces, 0, 0, ["zz"]), (pieces, 1, 1, ["x"])],
        "pieces array<array<string>>, start_word int, end_word int, answer_pieces array<string>",
    )
    got = [(r.tok_start, r.tok_end) for r in windows.align_answer_span(df.coalesce(1)).collect()]
    assert got == [(1, 1), (0, 5), (6, 6)]


def test_char_offsets(spark):
    rows = [("The leader was John Smith (1895).", "1895", 27), ("a b", "zz", 0), (" a", " ", 0)]
    df = spark.createDataFrame(rows, "context string, answer_text string, answer_start int")
    got = windows.char_word_offsets(df).collect()
    assert [(r.start_word, r.end_word) for r in got] == [(5, 5)]


@pytest.mark.parametrize(
    "piece_text, raw, final",
    [
        ("steve smith", "Steve Smith's", "Steve Smith"), ("zz", "Steve Smith", "Steve Smith"),
        ("smith", "Steve Smith's", "Smith"), ("b", "a  b", "b"), ("under e", "Under é!", "Under é"), ("", "Raw", "Raw"),
    ],
)
def test_project(spark, piece_text, raw, final):
    df = spark.createDataFrame([(piece_text, raw)], "p string, r string")
    got = spans.project_to_original(df, "p", "r").first().text
    assert got == final


def brute_nbest(wins, n, max_answer, with_null):
    """Candidate lists as nested loops over the windows of one question."""
    found = []
    for w, (start, end, ok, words) in enumerate(wins):
        top = lambda x: sorted(range(len(x)), key=lambda i: -x[i])[:n]
        for i in top(start):
            for j in top(end):
                if 2 <= i < 2 + len(ok) and 2 <= j < 2 + len(ok) and ok[i - 2] and i <= j < i + max_answer:
                    found.append((start[i] + end[j], " ".join(words[i - 2 : j - 1]), start[i], end[j]))
    nulls = [(s[0] + e[0], s[0], e[0]) for s, e, *_ in wins]
    null = min(nulls, key=lambda x: x[0])
    if with_null:
        found.append((null[0], "", null[1], null[2]))
    found.sort(key=lambda x: -x[0])
    out, seen = [], set()
    for score, text, s, e in found:
        if len(out) == n:
            break
        if text in seen and text:
            continue
        seen.add(text)
        out.append((text, s, e))
    if with_null and "" not in seen:
        out.append(("", null[1], null[2]))
    return out or [("empty", 0.0, 0.0)]


@pytest.mark.parametrize("with_null", [True, False])
def test_nbest(spark, with_null):
    rng = random.Random(4)
    feats, results, expected = [], [], {}
    for q in range(30):
        wins = []
        for w in range(rng.randrange(1, 4)):
            words = [rng.choice("abc") for _ in range(8)]
            ok = [rng.random() < (0.0 if q == 0 else 0.6) for _ in range(8)]
            start, end = [[rng.randrange(6) / 2 for _ in range(12)] for _ in range(2)]
            wins.append((start, end, ok, words))
            uid = q * 10 + w
            feats.append((uid, q, w, ["[CLS]", "[SEP]", *words, "[SEP]"], 0, list(range(8)), ok, words))
            results.append((uid, start, end))
        expected[q] = brute_nbest(wins, 4, 3, with_null)
    f = spark.createDataFrame(feats, "unique_id long, question_id long, win int, tokens array<string>, query_len int, token_to_word array<int>, is_max_context array<boolean>, words array<string>")
    r = spark.createDataFrame(results, "unique_id long, start_logits array<double>, end_logits array<double>")
    found = spans.candidate_texts(spans.span_candidates(f, r, 4, 3))
    nulls = spans.null_scores(f, r)
    listed = spans.nbest_answers(found, nulls, 4, with_null)
    got = {}
    for row in listed.orderBy("question_id", "rank").collect():
        got.setdefault(row.question_id, []).append((row.text, row.start_logit, row.end_logit))
    assert got == expected
    sums = listed.groupBy("question_id").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(x.p - 1) < 1e-9 for x in sums)
    if with_null:
        for row in spans.choose_answer(listed, nulls, 0.5).collect():
            best = next((x for x in expected[row.question_id] if x[0]), None)
            null = next(x for x in nulls.collect() if x.question_id == row.question_id)
            want = "" if best is None or null.null_score - best[1] - best[2] > 0.5 else best[0]
            assert row.answer == want


def test_cut_windows_hold_their_own_parts(spark):
    """The windows of whole documents, but no row carries more than its window: long documents made rows of their size squared."""
    rng = random.Random(7)
    docs = [(i, [[f"p{rng.randrange(9)}"] * rng.randrange(3) for _ in range(n)], [f"q{k}" for k in range(q)]) for i, (n, q) in
            enumerate([(0, 3), (1, 0), (12, 2), (40, 9), (3000, 1), (5, 30)])]
    df = spark.createDataFrame(docs, "doc_id bigint, pieces array<array<string>>, asked array<string>")
    df = df.withColumn("words", F.transform("pieces", lambda p, i: F.concat(F.lit("w"), i.cast("string"))))
    got = windows.cut_windows(df, 20, 5, 4, ["doc_id"], "pieces", "words", "asked").collect()
    whole = windows.doc_windows(df.withColumn("flat", F.flatten("pieces")), 20, 5, 4, "flat", "asked").drop("words").collect()
    by_key = {(r.doc_id, r.win): r for r in got}
    assert len(by_key) == len(got) == len(whole)
    for r in whole:
        mine, word_of = by_key[r.doc_id, r.win], [i for i, p in enumerate(r.pieces) for _ in p][r.start : r.start + r.length]
        assert mine.window == r.flat[r.start : r.start + r.length] and mine.query == r.asked[: r.query_len]
        assert [mine[c] for c in ("start", "length", "room", "step", "n_windows", "doc_size")] == [r[c] for c in ("start", "length", "room", "step", "n_windows", "doc_size")]
        assert [mine.words[i] for i in mine.word_of] == [f"w{i}" for i in word_of] and len(mine.words) == word_of[-1] - word_of[0] + 1
    longest = max(len(str(r)) for r in got)
    assert longest < 2000


def test_pack_uses_every_sentence():
    rng = random.Random(2)
    for case in range(300):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 40))]
        at = 0
        for c in kernels.pack(sizes, case, 61, 0.1, 5):
            assert c["first"] == at and c["first"] < c["cut"] <= c["last"]
            at = c["cut"] if c["is_random_next"] else c["last"]
        assert at == len(sizes)


def test_random_next_and_truncate(spark):
    docs = spark.createDataFrame(
        [(i, [[f"d{i}s{j}t{k}" for k in range(5)] for j in range(6)]) for i in range(20)], "doc_id bigint, sentences array<array<string>>"
    )
    chunks = masked_lm.pack_sentences(masked_lm.duplicate_with_seed(docs, 2), 23, 0.1, 9)
    paired = masked_lm.random_next(chunks, docs, 9)
    assert paired.count() == chunks.count()
    for r in paired.collect():
        own = {t[: t.index("s")] for t in r.a}
        other = {t[: t.index("s")] for t in r.b}
        assert (own == other) != r.is_random_next and len(r.b) > 0
    for r in masked_lm.truncate_pair(paired, 20, 9).collect():
        assert len(r.a) + len(r.b) <= 20 and r.a and r.b


def test_whole_word_masking():
    pieces = ["[CLS]", "un", "##want", "##ed", "a", "b", "[SEP]"]
    for key in map(str, range(200)):
        chosen = kernels.whole_word_order(pieces, key, 3)
        assert len(chosen) <= 3 and not {0, 6} & set(chosen)
        assert {1, 2, 3} <= set(chosen) or not {1, 2, 3} & set(chosen)


def test_instance_features(spark):
    vocab = features.PieceVocabulary(spark.createDataFrame(
        [(t, i) for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "b", "c"])], "token string, token_id int"
    ))
    df = spark.createDataFrame([("x", ["a", "b"], ["c"], True)], "inst_id string, a array<string>, b array<string>, is_random_next boolean")
    masked = masked_lm.mask_lm(masked_lm.instances(df), spark.createDataFrame([(0, "a")], "word_id long, word string"), 0.4, 4, 1)
    r = masked_lm.instance_features(masked, vocab, 8, 4).first()
    assert len(r.input_ids) == len(r.segment_ids) == 8 and r.segment_ids == [0, 0, 0, 0, 1, 1, 0, 0]
    assert sum(r.masked_lm_weights) == 2 and r.next_sentence_label == 1
    assert r.input_mask == [1] * 6 + [0, 0]


def test_answers_from_whole_documents(spark):
    """Some answers can be traced into their original words, others keep the whole stretch: unknown words and soft hyphens."""
    from redpen.plans import span_queries

    texts = [r.text for r in span_queries.span_candidates(spark, "/root/testdata/sf0.001").select("text").distinct().collect()]
    hyphened = sum("­" in t for t in texts)
    assert 0 < hyphened < len(texts) and max(map(len, texts)) > 20


@pytest.mark.parametrize("travels", [True, False])
def test_windows_of_tokens_are_those_of_their_pieces(spark, monkeypatch, travels):
    if not travels:
        monkeypatch.setattr(lookup, "TRAVEL_BYTES", -1)
    vocab = features.PieceVocabulary(spark.createDataFrame([("[PAD]", 0), ("[UNK]", 1), ("ab", 2), ("##c", 3), ("##d", 4), ("x", 5)], "token string, token_id int"))
    rng = random.Random(5)
    docs = [(i, [rng.choice(["abc", "abcd", "x", "zz", ",", "x-x"]) for _ in range(n)], ["x", "abc", "abcdc"][:q]) for i, (n, q) in enumerate([(0, 1), (1, 0), (30, 3), (400, 2), (7, 3)])]
    df = spark.createDataFrame([*docs, docs[2], (None, ["x"], ["x"])], "doc_id bigint, toks array<string>, asked array<string>")
    cut = windows.max_context(windows.cut_windows(df, 16, 5, 4, ["doc_id"], "toks", F.col("toks").alias("spelled"), "asked", vocab))
    step = vocab.add_pieces(df, pieces=F.col("toks"), q=F.col("asked")).withColumn("q", F.flatten("q"))
    old = windows.max_context(windows.cut_windows(step, 16, 5, 4, ["doc_id"], "pieces", "toks", "q"))
    assert sorted(map(repr, cut.select(*old.columns).collect())) == sorted(map(repr, old.collect()))


@pytest.mark.parametrize("name, kernels", [("null_scores", 1), ("span_candidates", 2), ("window_input_ids", 2)])
def test_windows_need_few_workers(spark, name, kernels):
    """Every kernel in a chain is a Python worker per core, and whole documents wait in front of those on documents."""
    from redpen.plans.catalog import CATALOG

    plan = CATALOG[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert len(re.findall(r"ArrowEvalPython \[|MapInArrow ", plan)) <= kernels
