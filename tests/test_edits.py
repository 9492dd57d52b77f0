"""Phrase mining, tags, realisation and feature rows."""

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from redpen.functions import kernels
from redpen.operators import features, predict, tagging, vocabulary


def longest(a, b):
    """Length of the longest common subsequence, by trying all subsequences of a."""
    def inside(part):
        rest = iter(b)
        return all(x in rest for x in part)

    return max(n for n in range(len(a) + 1) if any(inside(part) for part in itertools.combinations(a, n)))


def picked(a, b):
    """The stated choice: equal ends are common; otherwise the source is shortened where that costs nothing."""
    if not a or not b:
        return []
    if a[-1] == b[-1]:
        return [*picked(a[:-1], b[:-1]), a[-1]]
    return picked(a[:-1], b) if longest(a[:-1], b) == longest(a, b) else picked(a, b[:-1])


def test_lcs():
    assert kernels.lcs_tokens("red fox ran home".split(), "fox cub ran far home".split()) == ["fox", "ran", "home"]
    rng = random.Random(5)
    for _ in range(600):
        a = [rng.choice("abc") for _ in range(rng.randrange(8))]
        b = [rng.choice("abc") for _ in range(rng.randrange(8))]
        assert kernels.lcs_tokens(a, b) == picked(a, b)


def test_lcs_long_texts():
    words = [f"w{i % 50}" for i in range(20_000)]
    assert kernels.lcs_tokens(words, words[::1]) == words


def test_added_phrases(spark):
    rows = [
        (1, ["Rain fell all day .", "Rivers rose ."], "Now rain fell all day so quickly rivers rose ."),
        (2, ["a b"], "a b"),
    ]
    df = spark.createDataFrame(rows, "pair_id bigint, sources array<string>, target string")
    got = {r.pair_id: r.phrases for r in vocabulary.added_phrases(df).collect()}
    assert got[1][0] == "now" and got[2] == []
    for _, sources, target in rows:
        kept = kernels.lcs_tokens(" ".join(sources).lower().split(), target.lower().split())
        phrases = kernels.added_phrases(" ".join(sources), target)
        assert len(kept) + sum(len(p.split()) for p in phrases) == len(target.split())


def test_swap_is_taken_only_when_shorter():
    assert kernels.fewest_added_phrases(["b c", "a"], "a b c", True) == []
    assert kernels.fewest_added_phrases(["b c", "a"], "a b c", False) == ["a"]


def test_coverage(spark):
    lists = [["so", "while"], ["while"], ["yet"], [], ["while", "so"]]
    mined = spark.createDataFrame(list(enumerate(lists)), "pair_id bigint, phrases array<string>")
    ranked = vocabulary.phrase_vocabulary(vocabulary.phrase_counts(mined), 10)
    curve = vocabulary.coverage_curve(mined, ranked).orderBy("k").collect()
    assert [(r.phrase, r.freq) for r in curve] == [("while", 3), ("so", 2), ("yet", 1)]
    assert [round(r.coverage * 5 / 100) for r in curve] == [2, 4, 5]


def test_label_map(spark):
    mined = spark.createDataFrame([(0, ["b", "a", "b"])], "pair_id bigint, phrases array<string>")
    ranked = vocabulary.phrase_vocabulary(vocabulary.phrase_counts(mined), 10)
    rows = vocabulary.label_map_table(ranked, 1, swap=True).orderBy("tag_id").collect()
    assert [(r.tag, r.tag_id) for r in rows] == [("KEEP", 0), ("DELETE", 1), ("SWAP", 2), ("KEEP|b", 3), ("DELETE|b", 4)]
    bad = spark.createDataFrame([("DROP|x", 0)], "tag string, tag_id int")
    with pytest.raises(Exception, match="unknown tag type"):
        vocabulary.parse_tags(bad).collect()


K, D = "KEEP", "DELETE"
WORDS, ADDED = "abc", ("x", "y", "x y")  # no word of a phrase is a word of a source


def told(sources, tags):
    """The target that tags stand for, by their meaning: a phrase, then the token unless it goes; SWAP turns the sources round."""
    parts = [s.split() for s in sources]
    pairs = list(zip([t for p in parts for t in p], tags, strict=True))
    first = len(parts[0])
    if len(parts) == 2 and tags[first - 1].startswith("SWAP"):
        pairs = pairs[first:] + pairs[:first]
    return [w for token, tag in pairs for w in [*tag.partition("|")[2].split(), *([] if tag.startswith(D) else [token])]]


def reachable(source, target, phrases):
    """Whether some choice of kept tokens, each with at most one phrase before it, spells the target."""
    if not target:
        return True
    for n in range(len(target)):
        if n == 0 or " ".join(target[:n]) in phrases:
            for at, token in enumerate(source):
                if token == target[n] and reachable(source[at + 1 :], target[n + 1 :], phrases):
                    return True
    return False


SOURCE = st.lists(st.sampled_from(WORDS), min_size=1, max_size=5)


@settings(max_examples=400, deadline=None)
@given(st.lists(SOURCE, min_size=1, max_size=2), st.lists(st.sampled_from(WORDS + "xy"), min_size=1, max_size=6), st.sets(st.sampled_from(ADDED)), st.booleans())
def test_tagger_by_trying_everything(parts, target, phrases, swap):
    sources = [" ".join(p) for p in parts]
    tags, swapped = kernels.Tagger(phrases).tags(sources, " ".join(target), swap)
    straight = reachable([t for p in parts for t in p], target, phrases)
    turned = swap and len(parts) == 2 and reachable(parts[1] + parts[0], target, phrases)
    assert bool(tags) == (straight or turned) and swapped == (turned and not straight)
    if tags:
        # SWAP takes the place of the last token's own kind, so that token stays even where the target ends before it
        assert told(sources, tags) in ([target, [*target, parts[0][-1]]] if swapped else [target])
        assert {t.partition("|")[2] for t in tags} <= {*phrases, ""}


def random_tagged(seed, n):
    """Rows with sources and the target that random tags give."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        parts = [rng.choices(["Red", "sky", "ünder", "no", "."], k=rng.randint(1, 8)) for _ in range(rng.randint(1, 2))]
        tags, held = [], False
        for _ in [t for p in parts for t in p]:
            tag = rng.choice([K, K, D])
            if not held and rng.random() < 0.3:  # one phrase for a gap
                tag, held = f"{tag}|{rng.choice(['but', 'or so'])}", True
            held = held and tag.startswith(D)
            tags.append(tag)
        target = told([" ".join(p) for p in parts], tags)
        while target and target[-1] in ("but", "or", "so"):  # nothing can be added behind the last kept token
            target.pop()
        if target:
            rows.append((i, [" ".join(p) for p in parts], " ".join(target)))
    return rows


def test_tags_and_back(spark):
    """Whatever random tags made is found again and realised as the same words."""
    rows = random_tagged(8, 400)
    df = spark.createDataFrame(rows, "pair_id bigint, sources array<string>, target string")
    labels = spark.createDataFrame([("KEEP", 0), ("DELETE|but", 1), ("KEEP|or so", 2)], "tag string, tag_id int")
    tagged = tagging.tag_pairs(df, labels)
    done = tagging.realize(tagged).collect()
    assert len(done) == len(rows) > 300
    for r in done:
        assert r.feasible and r.realized.lower().split() == r.target.lower().split()
    none = spark.createDataFrame([(1, [""], "x"), (2, ["a"], "b")], "pair_id bigint, sources array<string>, target string")
    assert not any(r.feasible for r in tagging.tag_pairs(none, labels).collect())


REALIZE = [
    (["A b ."], [K, K, K], "A b ."),
    (["A b ."], [K, D, K], "A ."),
    (["A b ."], ["KEEP|x y", "DELETE|z", K], "x y A z ."),
    (["1st sentence .", "Second one ."], [K, K, "SWAP", K, K, K], "Second one . 1st sentence ."),
    (["First one .", "second two ."], [K, K, D, K, K, K], "First one second two ."),
    (["First one .", "second two ."], [K, K, K, K, K, K], "First one . Second two ."),
    (["First one", "Second two ."], [K, K, K, K, K], "First one second two ."),
    (["First one .", "second two ."], [D, D, D, K, K, K], " Second two ."),
    (["A swap b ."], [K, "SWAP", K, K], "A swap b ."),
]


def test_realize(spark):
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(REALIZE)], "id int, sources array<string>, tags array<string>")
    got = {r.id: r.realized for r in tagging.realize(df).collect()}
    assert [got[i] for i in range(len(REALIZE))] == [out for *_, out in REALIZE]
    wrong = spark.createDataFrame([(["a b"], ["KEEP"])], "sources array<string>, tags array<string>")
    with pytest.raises(Exception, match="differs from number of tokens"):
        tagging.realize(wrong).collect()


VOCAB = "[CLS] [SEP] [PAD] a b c ##d ##e This is test . Test 1 2".split()


@pytest.fixture(scope="module")
def vocab(spark):
    table = spark.createDataFrame([(t, i) for i, t in enumerate(VOCAB)], "token string, token_id int")
    return features.PieceVocabulary(table, lower=False)


LABELS = {"KEEP": 0, "DELETE": 1, "KEEP|and": 2}


def test_features(spark, vocab):
    rows = [(1, "a b ade", ["DELETE", "DELETE", "KEEP"])]
    df = spark.createDataFrame(rows, "pair_id bigint, s string, tags array<string>").withColumn("tokens", F.split("s", " "))
    r = features.edit_features(df, vocab, {"KEEP": 1, "DELETE": 2}, 8).first()
    assert r.input_ids == [0, 3, 4, 3, 6, 7, 1, 2]
    assert r.input_mask == [1, 1, 1, 1, 1, 1, 1, 0]
    assert r.segment_ids == [0] * 8
    assert r.labels == [0, 2, 2, 1, 1, 1, 0, 0]
    assert r.labels_mask == [0, 1, 1, 1, 1, 1, 0, 0]
    assert r.token_starts == [1, 2, 3]


def test_features_cut(spark, vocab):
    rows = [(1, "ade bed cde".split(), ["KEEP", "DELETE", "DELETE"])]
    df = spark.createDataFrame(rows, "pair_id bigint, tokens array<string>, tags array<string>")
    r = features.edit_features(df, vocab, {"KEEP": 1, "DELETE": 2}, 8).first()
    assert r.input_ids == [0, 3, 6, 7, 4, 7, 6, 1]
    assert r.labels == [0, 1, 1, 1, 2, 2, 2, 0]
    assert r.token_starts == [1, 4, 7]


def test_sentence_segments(spark, vocab):
    df = spark.createDataFrame([(1, "Test 1. Test 2".split(), [K, K, K, K])], "pair_id bigint, tokens array<string>, tags array<string>")
    r = features.edit_features(df, vocab, {"KEEP": 1}, 10, "sentence").first()
    assert r.input_ids == [0, 12, 13, 11, 12, 14, 1, 2, 2, 2]
    assert r.segment_ids == [0, 0, 0, 0, 1, 1, 0, 0, 0, 0]


def test_pos_ids(spark):
    tags = ["DT", "VBZ", "DT", "NN", "NN", "??"]
    df = spark.createDataFrame([(tags,)], "t array<string>")
    assert df.select(features.pos_ids(F.col("t"), "full").alias("i")).first().i == [5, 33, 5, 14, 14, 40]


def test_pos_embedding_ends(spark, vocab):
    df = spark.createDataFrame([(1, ["a", "b"], [K, K], ["NOUN", "VERB"])], "pair_id bigint, tokens array<string>, tags array<string>, pos_tags array<string>")
    assert features.edit_features(df, vocab, {"KEEP": 1}, 6, "pos_concise").first().segment_ids == [2, 4, 3, 16, 0, 0]
    full = df.withColumn("pos_tags", F.array(F.lit("NN"), F.lit("VB")))
    assert features.edit_features(full, vocab, {"KEEP": 1}, 6, "pos").first().segment_ids == [2, 14, 28, 41, 0, 0]


def test_unknown_tag_is_an_error(spark, vocab):
    df = spark.createDataFrame([(1, ["a"], ["SWAP"])], "pair_id bigint, tokens array<string>, tags array<string>")
    with pytest.raises(Exception, match="SWAP"):
        features.edit_features(df, vocab, {"KEEP": 1}, 6).collect()


@pytest.mark.parametrize(
    "given, lower, tokens",
    [
        ("ah博推zz", True, ["ah", "博", "推", "zz"]),
        (" \tHeLLo!how  \n Are yoU?  ", True, ["hello", "!", "how", "are", "you", "?"]),
        ("Héllo", True, ["hello"]),
        (" \tHeLLo!how  \n Are yoU?  ", False, ["HeLLo", "!", "how", "Are", "yoU", "?"]),
        ("a\x00b�c​d", True, ["abcd"]),
        ("$5^x`~", True, ["$", "5", "^", "x", "`", "~"]),
    ],
)
def test_basic_tokens(given, lower, tokens):
    assert kernels.basic_tokens(given, lower) == tokens


def test_word_pieces():
    known = {"[UNK]", "want", "##want", "##ed", "wa", "un", "runn", "##ing"}
    cut = lambda text: [p for w in text.split() for p in kernels.word_pieces(w, known)]
    assert cut("") == []
    assert cut("unwanted running") == ["un", "##want", "##ed", "runn", "##ing"]
    assert cut("unwantedX running") == ["[UNK]", "runn", "##ing"]
    assert kernels.word_pieces("a" * 201, {"a", "##a"}) == ["[UNK]"]


def test_token_labels(spark):
    df = spark.createDataFrame([([0, 1, 0, 2, 0], [0, 1, 1, 0, 0], [1, 2, 3, 9])], "l array<int>, m array<int>, s array<int>")
    got = df.select(features.token_labels(F.col("l"), lambda at: F.get("m", at) != 0, F.col("s"), 7).alias("x")).first().x
    assert got == [1, 0, 7, 7]


@pytest.mark.parametrize("a, b, room", [(a, b, r) for a in range(9) for b in range(1, 9) for r in (4, 5)])
def test_fitted_lengths_formula(a, b, room):
    x, y = a, b
    while x + y > room:
        if x > y:
            x -= 1
        else:
            y -= 1
    keep_a = min(a, max(-(-room // 2), room - b))
    keep_b = min(b, max(room // 2, room - a))
    assert (keep_a, keep_b) == (x, y)


def test_pair_features(spark, vocab):
    df = spark.createDataFrame([("a b", "c ade", "y"), ("a b c", None, "n")], "text_a string, text_b string, label string")
    two, one = features.pair_features(df.coalesce(1), vocab, 8, ["n", "y"]).collect()
    assert (two.input_ids, two.segment_ids, two.label_id) == ([0, 3, 4, 1, 5, 3, 6, 1], [0, 0, 0, 0, 1, 1, 1, 1], 1)
    assert (one.input_ids, one.input_mask, one.label_id) == ([0, 3, 4, 5, 1, 0, 0, 0], [1, 1, 1, 1, 1, 0, 0, 0], 0)


def test_mask_slots(spark):
    make = lambda tokens: spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, token_id int")
    out = features.vocab_with_mask_tokens(make(["a", "[unused1]", "[UNUSED_2]"])).orderBy("token_id").collect()
    assert [r.token for r in out] == ["a", "[SYMBOL]", "[NUMBER]"]
    same = features.vocab_with_mask_tokens(make(["[NUMBER]", "[SYMBOL]"])).orderBy("token_id").collect()
    assert [r.token for r in same] == ["[NUMBER]", "[SYMBOL]"]
    with pytest.raises(IndexError):
        features.vocab_with_mask_tokens(make(["a", "[unused1]"]))


def test_loss_weights(spark):
    labels = spark.createDataFrame([("KEEP", 0), ("DELETE", 1), ("SWAP", 2), ("KEEP|x", 3), ("DELETE|x", 4)], "tag string, tag_id int")
    df = spark.createDataFrame([([0, 1, 2, 3, 4], [3, 3, 3, 3, 9])], "labels array<int>, segment_ids array<int>")
    out = tagging.token_loss_weights(df, labels, add=2.0, keep=3.0, delete=5.0, verb=1.0, tagset="concise").first()
    assert out.weights == [3.0, 10.0, 1.0, 6.0, 10.0]


def test_predict_missing_labels_keep(spark, vocab):
    labels = spark.createDataFrame(list(LABELS.items()), "tag string, tag_id int")
    df = spark.createDataFrame([(1, ["a b ade"], "x")], "row_id bigint, sources array<string>, target string")

    def factory():
        return lambda frame: [[0, 1, 0, 2, 0] for _ in range(len(frame))]

    out = predict.predict_table(df, factory, vocab, labels, 8).first()
    assert out.prediction == "b and ade"

    def short():
        return lambda frame: [[0, 1, 0] for _ in range(len(frame))]

    assert predict.predict_table(df, short, vocab, labels, 8).first().prediction == "b ade"


def test_prepare_needs_target(spark):
    df = spark.createDataFrame([(1, "I've  eaten.")], "row_id bigint, source string")
    with pytest.raises(ValueError):
        predict.prepare_inputs(df, True)
    row = predict.prepare_inputs(df, False).first()
    assert row.source == row.target == "I 've eaten ."
