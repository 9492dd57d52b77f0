"""Dimension tables that travel and tables that are joined give the same rows."""

import random

import pytest
from compare import connect, difference
from pyspark.sql import functions as F

import __spark_entry__
from redpen.functions import kernels
from redpen.operators import features, lookup, tagging

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joined(monkeypatch):
    """No table travels, and few rows are enough for a broadcast."""
    monkeypatch.setattr(lookup, "TRAVEL_BYTES", -1)
    monkeypatch.setattr(lookup, "HEAVY", 50)


@pytest.mark.parametrize("name", ["tag_pairs", "tag_fusion", "token_loss_weights", "wordpiece_table", "edit_features", "pair_features", "predict_table", "instance_features", "mask_lm"])
def test_joined_tables_against_sql(spark, joined, name):
    query, sql = __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]
    assert difference(query(spark, SF), connect(SF), sql) is None


def test_label_map_of_two_million_rows(spark):
    """More phrases than may travel: the same tags as with the few phrases that the texts hold."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    phrases = {" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(300)}
    rows = []
    for i in range(300):
        source = rng.choices(words, k=12)
        target = [t for w in source for t in ([*rng.choice(sorted(phrases)).split(), w] if rng.random() < 0.3 else [w] * (rng.random() < 0.8))]
        sources = [" ".join(source)] if i % 2 else [" ".join(source[:6]), " ".join(source[6:])]
        rows.append((i, sources, " ".join(target)))
    rows += [(1000 + i, *rows[0][1:]) for i in range(200)] + [(2000, None, "x"), (2001, ["w1"], None), (2002, [""], "")]
    pairs = spark.createDataFrame(rows, "pair_id long, sources array<string>, target string")
    few = spark.createDataFrame([("KEEP", 0), ("DELETE", 1)] + [(f"KEEP|{p}", 2 + i) for i, p in enumerate(sorted(phrases))], "tag string, tag_id int")
    many = spark.range(2_000_000).selectExpr("concat('KEEP|never said ', id) tag", "cast(id + 1000 as int) tag_id").unionByName(few)
    assert lookup.travelling(many) is None and lookup.travelling(few) is not None
    want, got = (sorted(map(str, tagging.tag_pairs(pairs, m).select("pair_id", "tags", "feasible", "swapped").collect())) for m in (few, many))
    assert got == want and sum("feasible=True" in r for r in got) > 200


def test_vocabulary_of_any_size(spark, joined):
    """Pieces, sentence pieces and ids of odd tokens as from the table that travels."""
    rng = random.Random(5)
    table = ["[PAD]", "[UNK]", "[SEP]", *"abcé.", *[f"##{c}" for c in "abc."], "ab", "##ca", "abca", "一"]
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(table)], "token string, token_id int")
    tokens = ["abca", "ABCAb", "éa", "zebra", "a.b", "", "一a", "a" * 300, "́"]
    rows = [(i, rng.choices(tokens, k=rng.randint(0, 5)), [rng.choices(tokens, k=rng.randint(0, 3)) for _ in range(rng.randint(0, 3))]) for i in range(60)] + [(99, None, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, sentences array<array<string>>")
    slow = features.PieceVocabulary(vocab)
    assert slow.lookup.rows is None and slow.pad_id == 0
    known = frozenset(table)

    def cut(token):
        return [p for w in kernels.basic_tokens(token) for p in kernels.word_pieces(w, known)]

    done = slow.add_pieces(df, pieces=F.col("tokens"))
    done = slow.add_ids(slow.add_sentence_pieces(done.filter("sentences is not null"), "cut", F.col("sentences")), ids=F.flatten("pieces"))
    got = {r["id"]: r for r in done.collect()}
    assert len(got) == 60
    for i, toks, sents in rows[:60]:
        assert got[i]["pieces"] == [cut(t) for t in toks] and got[i]["cut"] == [[p for t in s for p in cut(t)] for s in sents]
        assert got[i]["ids"] == [table.index(p) for t in toks for p in cut(t)]


def test_unknown_entries(spark, joined):
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    df = spark.createDataFrame([(1, ["a", "x", None]), (2, [])], "id long, xs array<string>")
    assert [r["out"] for r in lookup.Lookup(table, "k", "v", default=7).add(df, "out", F.col("xs")).orderBy("id").collect()] == [[1, 7, 7], []]
    with pytest.raises(Exception, match="KeyError"):
        lookup.Lookup(table, "k", "v").add(df, "out", F.col("xs")).collect()
