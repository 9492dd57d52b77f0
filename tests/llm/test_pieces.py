"""Piece encoding against the public library with the same pieces and scores, and round trips."""

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from redpen.llm import pieces
from redpen.llm.queries import op7_unigram_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = pieces.Vocabulary.load(PATH)
SEGMENTER = pieces.Segmenter(VOCABULARY)


def library():
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, VOCABULARY.scores):
        piece.score = score
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


LIBRARY = library()


def score_of(ids):
    return sum(VOCABULARY.scores[i] for i in ids if not LIBRARY.is_byte(int(i)))


def same(text):
    ids, sizes, _ = SEGMENTER.texts([text])
    want = LIBRARY.encode(text)
    # equal scores may be cut in two ways; byte pieces must be the same
    assert ids.tolist() == want or abs(score_of(ids) - score_of(want)) < 1e-3
    assert pieces.decode(VOCABULARY.pieces, ids) == text.replace(pieces.MARKER, " ")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdethion  \n\té漢字😀▁.,!0123456789", max_size=50))
def test_random_texts(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "   a", "a  b ", "hello world", "▁", "\0x", "é" * 40, "the " * 300, "x" * 5000, "🏳️‍🌈"])
def test_special_texts(text):
    same(text)


def test_whole_documents(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    ids, sizes, scores = SEGMENTER.texts(texts)
    want = LIBRARY.encode(texts)
    assert sum(map(len, want)) == pytest.approx(len(ids), rel=1e-4)
    at = exact = 0
    for text, n, score, theirs in zip(texts, sizes.tolist(), scores.tolist(), want):
        mine = ids[at : at + n].tolist()
        at += n
        exact += mine == theirs
        assert score_of(mine) == pytest.approx(score_of(theirs), abs=0.02)
        assert pieces.decode(VOCABULARY.pieces, __import__("numpy").array(mine)) == text
    assert exact > 0.9 * len(texts)


def test_trie_holds_all_pieces():
    trie, codes = VOCABULARY.trie, VOCABULARY.codes
    for i in range(259, 32000, 37):
        state = 0
        for c in LIBRARY.id_to_piece(i):
            after = trie.base[state] + codes[ord(c)]
            assert trie.check[after] == state
            state = after
        assert trie.value[state] == i


def test_odd_tables(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "", 1), (None, "a b", 1), (1, "a b", 1), (1, "a b", 1)], "doc_id long, text string, ids int")
    got = pieces.encode_pieces(rows, "doc_id", "text", PATH).collect()
    assert sorted(map(len, (r["ids"] for r in got))) == [0, 0, 2, 2, 2]
    assert pieces.encode_pieces(rows.limit(0), "doc_id", "text", PATH).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = op7_unigram_pieces(spark, sf)
    assert rows.count() == 200
    assert rows.filter(~F.col("round_trip")).count() == 0
