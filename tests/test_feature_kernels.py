"""Feature rows from one kernel: the same as from joined tables, and nothing is zipped, sorted or flattened by expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from redpen.functions import kernels
from redpen.operators import features, lookup, tagging

SF = "/root/testdata/sf0.001"
TABLE = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcé.", *[f"##{c}" for c in "abc."], "ab", "##ca", "abca", "一"]
TOKENS = ["abca", "ABCAb", "éa", "zebra", "a.b", "一a", "a" * 300, "\u0301", "ab,", "."]


@pytest.mark.parametrize("name", [
    "edit_features", "meaning_features", "pair_features", "wordpiece_table", "pos_segments", "instance_features", "attach_quality_label"
])
def test_no_expression_per_piece(spark, name):
    """Before, pieces came back as nested lists, which were flattened, zipped and sorted by Spark's expressions."""
    frame = __spark_entry__.queries()[name](spark, SF)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert not re.findall(r"\b(?:zip_with|array_sort)\(", plan)
    assert "flatten(" not in plan or name == "attach_quality_label"


def _rows(df, drop=()):
    return sorted(str(sorted((k, v) for k, v in r.asDict().items() if k not in drop)) for r in df.collect())


@pytest.mark.parametrize("embedding", ["normal", "sentence", "pos", "pos_concise"])
def test_edit_rows_as_from_joined_tables(spark, monkeypatch, embedding):
    rng = random.Random(7)
    rows = []
    for i in range(80):
        n = rng.randint(0, 9)
        tags = rng.choices(["KEEP", "DELETE"], k=n if i % 4 else rng.randint(0, n))
        rows.append((i, rng.choices(TOKENS, k=n), tags, rng.choices(["VERB", "NN", "?"], k=n)))
    rows.append((99, [], [], []))
    df = spark.createDataFrame(rows, "pair_id long, tokens array<string>, tags array<string>, pos_tags array<string>")
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(TABLE)], "token string, token_id int")
    ids = {"KEEP": 1, "DELETE": 2}
    fast = _rows(features.edit_features(df, features.PieceVocabulary(vocab), ids, 9, embedding))
    monkeypatch.setattr(lookup, "TRAVEL_BYTES", -1)
    assert _rows(features.edit_features(df, features.PieceVocabulary(vocab), ids, 9, embedding)) == fast


def test_text_rows_as_from_joined_tables(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(TOKENS, k=rng.randint(0, 9))), rng.choice([None, "", "a\tb\x1cab", " ".join(rng.choices(TOKENS, k=5))])) for i in range(80)]
    df = spark.createDataFrame([*rows, (99, None, None)], "id long, text_a string, text_b string")
    table = spark.createDataFrame([(t, i) for i, t in enumerate(TABLE)], "token string, token_id int")

    def made():
        vocab = features.PieceVocabulary(table)
        pieced = vocab.add_piece_text(df.filter("id < 99"), out=F.col("text_a"))
        listed = vocab.add_flat_pieces(df.filter("id < 99"), out=F.col("text_a"))
        return [_rows(features.meaning_features(df, vocab, 9, "text_a", "text_b")), _rows(features.pair_features(df, vocab, 9)), _rows(pieced), _rows(listed)]

    fast = made()
    monkeypatch.setattr(lookup, "TRAVEL_BYTES", -1)
    assert made() == fast


def test_words_as_by_trying_all_prefixes():
    rng = random.Random(3)
    for _ in range(300):
        vocab = {("##" if rng.random() < 0.5 else "") + "".join(rng.choices("abc#é", k=rng.randint(0, 4))) for _ in range(30)}
        table = kernels.PieceTable(vocab)
        for _ in range(40):
            word = "".join(rng.choices("abc#éd", k=rng.randint(0, 9)))
            assert table.pieces(word) == kernels.word_pieces(word, vocab)


def test_starts_behind_the_row(spark):
    """Predictions ask only for tokens that begin in the row, so the words behind it are not cut."""
    table = spark.createDataFrame([(t, i) for i, t in enumerate(TABLE)], "token string, token_id int")
    df = spark.createDataFrame([(1, ["ab", "abca", "a", "b", "c"], ["KEEP"] * 5)], "pair_id long, tokens array<string>, tags array<string>")
    made = features.edit_features(df, features.PieceVocabulary(table), {"KEEP": 1}, 4, made=("row_starts",)).first()
    assert made.token_starts == [1, 2, 3, 4, 4] and made.input_ids == [2, 13, 15, 3] and "labels" not in made


def test_realized_with_missing_and_wrong_tags(spark):
    df = spark.createDataFrame([(1, ["a b", "c"], ["KEEP|x", "SWAP", None])], "id long, sources array<string>, tags array<string>")
    assert tagging.realize(df).first()["realized"] == " X a b"
    wrong = spark.createDataFrame([(1, ["a b"], ["KEEP"])], "id long, sources array<string>, tags array<string>")
    with pytest.raises(Exception, match="number of tags 1 differs from number of tokens 2"):
        tagging.realize(wrong).collect()
