"""Cleaning, tokenising, statistics, ratings and repair on small tables."""

import random

import pytest
from pyspark.sql import Observation, functions as F

from redpen.functions import kernels, text
from redpen.operators import pairs, predict, ratings, scoring, stats


def column(df, name):
    return [r[name] for r in df.collect()]


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, t string").coalesce(1)


@pytest.mark.parametrize(
    "given, cleaned",
    [
        ("\t\t\t", " "), ("\n" * 7, " "), ("\r", " "), ("text__text", "text_text"), ("text----text", "text-text"),
        ("a~~~b", "a~b"), ("a+++b", "a+b"), ("a...b", "a.b"), ("a:::b", "a:b"), ("-text", "text"), ("text-", "text"),
        ("text:", "text"), (":text", "text"), ("_text_", "text"), ("text~", "text"), ("~text", "~text"),
        (".text", "text"), ("text.", "text."), ("a   b c", "a b c"), ("  - a", " a"),
    ],
)
def test_clean(spark, given, cleaned):
    assert column(pairs.clean_text(texts(spark, [given]), ["t"]), "t") == [cleaned]


def test_unicode_spaces_split(spark):
    got = column(texts(spark, ["a b c\x1dd"]).select(text.tokens(F.col("t")).alias("t")), "t")
    assert got == ["a b c\x1dd".split()]


def test_drop_empty_and_count(spark):
    rows = [("a", "b"), (" ", "x"), ("c", ""), ("d", None), ("e", "f")]
    df = spark.createDataFrame(rows, "source string, target string")
    seen = Observation()
    kept = pairs.drop_empty_pairs(df, seen=seen)
    assert sorted(column(kept, "source")) == ["a", "e"]
    assert seen.get["dropped"] == 3


def test_validate(spark):
    good = spark.createDataFrame([("a", "b")], "source string, target string")
    assert pairs.validate_pairs(good) is good
    with pytest.raises(ValueError):
        pairs.validate_pairs(spark.createDataFrame([("a", " ")], "source string, target string"))


@pytest.mark.parametrize(
    "given, spaced",
    [
        ("I've eaten.", "I 've eaten ."), ("Have you?", "Have you ?"), ("He can't, she won't.", "He ca n't , she wo n't ."),
        ("It costs $5,000; ok", "It costs $ 5,000 ; ok"), ("(a) [b]", "( a ) [ b ]"), ("cannot cannot", "can not can not"),
    ],
)
def test_treebank(spark, given, spaced):
    assert column(texts(spark, [given]).select(text.treebank(F.col("t")).alias("t")), "t") == [spaced]


def test_stats(spark):
    df = spark.createDataFrame([("sentences 1", "sum 1"), ("sentences number 2", "2")], "source string, target string")
    s = stats.pair_stats(df).first()
    assert (s.source_words_mean, s.source_words_std, s.source_words_max, s.source_words_min) == (2.5, 0.5, 3, 2)
    assert (s.target_words_mean, s.target_words_std, s.target_words_max, s.target_words_min) == (1.5, 0.5, 2, 1)
    assert (s.sentences_mean, s.sentences_std, s.new_words_mean, s.new_words_std) == (1.0, 0.0, 0.5, 0.5)
    assert (round(s.ratio_mean, 2), round(s.ratio_std, 2)) == (0.67, 0.33)


def test_rated_rows(spark):
    most, little = ratings.COMMENTS[0], ratings.COMMENTS[-1]
    line = " ||| ".join(
        ["PlaceHolder", "PlaceHolder", "OriginalSentence", "Summary1", "7", "7", "7", most, "Summary2", "9", "9", "9", little]
    )
    df = spark.createDataFrame([(1, line)], "row_id int, line string")
    rated = ratings.explode_rated_summaries(df)
    assert [(r.source, r.target, r.ratings) for r in rated.collect()] == [
        ("OriginalSentence", "Summary1", ["7"]), ("OriginalSentence", "Summary2", ["9"]),
    ]
    seen = Observation()
    assert column(ratings.filter_low_rated(rated, seen=seen), "target") == ["Summary1"]
    assert seen.get["excluded"] == 1


def test_low_rated_counts_codes_once(spark):
    rows = [(["9", "9", "9"],), (["9", "14"],), ([],), (["9", "6"],), (["6", "7", "9"],)]
    df = spark.createDataFrame(rows, "ratings array<string>")
    assert column(df.select(ratings.low_rated(F.col("ratings")).alias("low")), "low") == [False, True, False, True, False]


def test_rating_labels(spark):
    df = spark.createDataFrame([(["6", "6", "7"],), (["7", "6"],), ([],), (["24"],)], "ratings array<string>")
    got = [(r.grammar, r.meaning) for r in ratings.rating_labels(df).collect()]
    assert got == [(1, 1), (0, 1), (0, 0)]


@pytest.mark.parametrize(
    "given, repaired",
    [
        ("' \" Test", "Test"), ("[ ] . . Test [ ] Test", "Test [ ] Test"), ("[ Test ]", "[ Test ]"),
        ("Test . ? Test", "Test . Test"), (") Test (", "Test"), ("\" a \"", "a"), ("a , , b ! ?", "a , b !"),
    ],
)
def test_repair(given, repaired):
    assert " ".join(kernels.repaired_tokens(given.split())) == repaired


def plain_repair(words):
    """Partners by pairing off neighbouring brackets of a kind again and again; then each word by itself."""
    marks, brackets, partner = ",.:!?", "{}[]()", {}
    plain = [i for i, w in enumerate(words) if w not in [*marks, *brackets, '"', "'"]]
    first = plain[0] if plain else len(words)
    for kind in ("{}", "[]", "()"):
        left = [i for i, w in enumerate(words) if w in list(kind)]
        while (k := next((k for k in range(len(left) - 1) if words[left[k]] + words[left[k + 1]] == kind), None)) is not None:
            i, j = left[k : k + 2]
            partner[i], partner[j] = j, i
            del left[k : k + 2]

    def stays(i, w):
        if w in ('"', "'"):
            return False
        if w in list(marks):
            return i > first and words[i - 1] not in list(marks)
        if w in list(brackets):
            return i in partner and max(i, partner[i]) > first
        return True

    return [w for i, w in enumerate(words) if stays(i, w)]


def test_repair_random():
    rng = random.Random(1)
    for _ in range(2000):
        words = [rng.choice(["a", "b", ".", ",", "?", "[", "]", "(", ")", '"', "'"]) for _ in range(rng.randrange(11))]
        assert kernels.repaired_tokens(words) == plain_repair(words)


def test_clean_predictions(spark):
    df = spark.createDataFrame([("[ ] . . Test [ ] Test",), ("I ca n't go , he said .",)], "prediction string")
    assert column(predict.clean_predictions(df), "prediction") == ["Test [] Test", "I can't go, he said."]


def test_masking(spark):
    pieces = ["abc", "12", "##12", "##ab", "##a1", ".", "##.", "[CLS]", "%", "é"]
    df = spark.createDataFrame([(pieces,)], "pieces array<string>")
    assert pairs.mask_tokens(df).first().pieces == [
        "abc", "[NUMBER]", "[NUMBER]", "##ab", "[SYMBOL]", ".", "##.", "[CLS]", "[SYMBOL]", "é",
    ]


def sari(spark, source, prediction, targets, strip):
    df = spark.createDataFrame([(0, source, prediction, targets)], "id int, source string, prediction string, targets array<string>")
    r = scoring.sari_rows(df, ["id"], strip).first()
    return [round(x, 6) for x in (r.sari, r.keep, r.addition, r.deletion)]


def test_sari_goldens(spark):
    assert sari(spark, "a b c", "a b d", ["a b c d e"], True) == [0.344444, 0.616667, 0.166667, 0.25]
    assert sari(spark, "a b c", "a <::::> b d", ["a <::::> b c d e"], True) == [0.344444, 0.616667, 0.166667, 0.25]
    assert sari(spark, "a b c", "a <::::> b d", ["a <::::> b c d e"], False) == [0.597619, 0.7, 0.42619, 0.666667]


def brute_sari(source, prediction, targets):
    def f1(tp, sel, rel):
        p = tp / sel if sel > 0 else 1
        r = tp / rel if rel > 1e-9 else 1
        return 2 * p * r / (p + r) if p > 0 and r > 0 else 0

    totals = [0.0, 0.0, 0.0]
    for n in range(1, 5):
        def grams(t):
            w = t.split()
            return {tuple(w[i : i + n]) for i in range(len(w) + 1 - n)}

        s, p = grams(source), grams(prediction)
        ts = [g for g in map(grams, targets) if g]
        w = {g: sum(g in t for t in ts) / len(ts) for g in set().union(*ts)} if ts else {}
        totals[0] += f1(sum(w.get(g, 0) for g in s & p), len(s & p), sum(w.get(g, 0) for g in s))
        totals[1] += f1(len((p - s) & set(w)), len(p - s), len(set(w) - s))
        totals[2] += f1(sum(1 - w.get(g, 0) for g in s - p), len(s - p), sum(1 - w.get(g, 0) for g in s))
    k, a, d = (t / 4 for t in totals)
    return [(k + a + d) / 3, k, a, d]


def test_sari_random(spark):
    rng = random.Random(3)
    make = lambda: " ".join(rng.choice("abcd") for _ in range(rng.randrange(8)))
    rows = [(i, make(), make(), [make() for _ in range(rng.randrange(1, 4))]) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, source string, prediction string, targets array<string>")
    got = {r.id: (r.sari, r.keep, r.addition, r.deletion) for r in scoring.sari_rows(df, ["id"]).collect()}
    for i, s, p, t in rows:
        assert got[i] == pytest.approx(brute_sari(s, p, t))


def test_exact(spark):
    df = spark.createDataFrame([("a b c", ["a b c", "x"]), ("d ef", ["def"])], "prediction string, targets array<string>")
    assert scoring.exact_score(df).first().exact == 0.5
    assert scoring.exact_score(df.limit(0)).first().exact == 0.0


def test_class_report(spark):
    pairs_ = list(zip([0, 1, 0, 1, 1, 0], [1, 0, 1, 0, 1, 0]))
    rows = scoring.class_report(spark.createDataFrame(pairs_, "prediction int, target int")).collect()
    zero = next(r for r in rows if r["class"] == 0)
    assert [zero.precision, zero.recall, zero.f1] == pytest.approx([1 / 3] * 3)
    never = scoring.class_report(spark.createDataFrame([(1, 0), (2, 1)], "prediction int, target int")).collect()
    assert sorted((r["class"], r.f1) for r in never) == [(0, 0.0), (1, 0.0)]


def test_first_characters_stay_single(spark):
    """As the SQL of realised texts: a letter whose capital is several letters has a single one or stays."""
    df = texts(spark, ["\u00dfa", "\u1f80a", "\u0149a", "\ufb01a", "\u00e4a", "", "\u0130A", "\u00c4A"])
    assert column(df.select(text.upper_first(F.col("t")).alias("u")), "u")[:6] == ["\u1e9ea", "\u1f88a", "\u0149a", "\ufb01a", "\u00c4a", ""]
    assert column(df.select(text.lower_first(F.col("t")).alias("l")), "l")[5:] == ["", "iA", "\u00e4A"]


def test_treebank_by_word_and_by_text(spark):
    """Words are remembered one by one; the rules as Spark expressions over whole texts are the measure."""
    rows = ["Cannot gonna. GOTTA, d'ye 'tis (cannot) x", "a:b ::c 1,000, 2.5. e.g. U.S.A.", "It's we'll they're 'quoted' \"so\" .", ". . .) ...x '' 'em", " a\x1cb  c--d $5 50% [x]{y}<z> été. ß!", "", " \t "]
    out = F.concat(F.lit(" "), F.regexp_replace("t", text.SPACES, " "), F.lit(" "))
    for pattern, to in text.TREEBANK_RULES:
        out = F.regexp_replace(out, pattern, to)
    df = texts(spark, rows * 3)
    got = df.select(text.treebank(F.col("t")).alias("got"), F.trim(F.regexp_replace(out, " +", " ")).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    plan = df.select(text.treebank(F.col("t")))._jdf.queryExecution().toString()
    assert plan.count("regexp_replace") == 0


def test_detokenised_is_the_rules_in_order(spark):
    rows = ["can not Do n't gon na ( a ) [ b ] , c -- d ' s", "'T was it 's we 'll # 5 $ 6 50 % ; x ... y : z .", "a . ) ' \" ! ? .", "", "got ta . '"]
    out = F.concat(F.lit(" "), F.col("t"), F.lit(" "))
    for pattern, to in text.DETOKENISE_RULES:
        out = F.regexp_replace(out, pattern, to)
    got = texts(spark, rows).select(text.detokenised(F.split("t", " ")).alias("got"), F.trim(out).alias("want")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
