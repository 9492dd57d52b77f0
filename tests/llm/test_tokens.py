"""Token blocks: round trips, checkpoints, checksums, and the query against plain encoding."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from redpen.llm import encoding, tokens
from redpen.llm.queries import op5_rans_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY, ENCODER = Tokenizer.from_file(PATH), encoding.SpacedEncoder(PATH)


def plain(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 70_000, 300_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, 49_999).astype(np.uint32)
    freq = tokens.quantised(np.bincount(ids, minlength=50_000))
    assert freq.sum() == 1 << tokens.BITS and freq.min() >= 1
    coder = tokens.Coder(freq)
    data = tokens.write_block(coder, [7, None], np.array([n, 0]), ids)
    block = tokens.Block(data)
    assert block.doc_ids == [7, None]
    assert np.array_equal(block.ids(coder), ids)
    for a, b in [(0, n), (n // 3, n // 2), (n - 1, n), (n, n), (66_000, 66_010)]:
        if 0 <= a <= b <= n:
            assert np.array_equal(block.slice(coder, a, b), ids[a:b])
    if n > 60_000:
        assert len(data) < n * 1.3
    damaged = bytearray(data)
    damaged[-1] ^= 1
    with pytest.raises(ValueError):
        tokens.Block(bytes(damaged))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \0\n\t\x1cab1.,'éÀ×µs<|", "\u3000", "<|endoftext|>", "<|ENDOFTEXT|>"]), max_size=40).map("".join), max_size=4))
def test_units_give_the_ids_of_whole_texts(texts):
    """Strings of special tokens are their ids, as the library has it by default."""
    ids, sizes = ENCODER.encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(sizes))[: len(texts)]] == plain(texts)


def rows_of(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, shard int")
    out = str(tmp_path / "out")
    tokens.write_tokens(docs, "doc_id", "text", PATH, out)
    return sorted(tokens.read_tokens(spark, out).collect(), key=lambda r: r["start"])


def test_odd_tables(spark, tmp_path):
    rows = [(3, "b c", None, 1), (1, None, "x", 1), (None, "n", "x", 1), (2, "", "x", None), (3, "a", "x", 1), (3, "a", "x", 1), (9, "wo rd " * 60_000, "x", 1)]
    got = rows_of(spark, tmp_path, rows)
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 3, 3, 9]
    want = plain(["n", "", "", "a", "a", "b c", "wo rd " * 60_000])
    at = 0
    for r, ids in zip(got, want):
        assert np.frombuffer(r["ids"], "<u4").tolist() == [*ids, 0]
        assert r["start"] == at
        at += r["n_tokens"]


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, tmp_path, []) == []


def test_query_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    at, want = 0, []
    for (doc, _), ids in zip(docs, plain([t or "" for _, t in docs])):
        want.append((doc, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(map(tuple, op5_rans_tokens(spark, sf).collect())) == want


def test_a_run_goes_to_the_library_once():
    class Recorder:
        def __init__(self, merges):
            self.merges, self.sent = merges, []

        def encode(self, text, **kwargs):
            self.sent.append(text)
            return self.merges.encode(text, **kwargs)

        def encode_batch_fast(self, texts, **kwargs):
            self.sent += texts
            return self.merges.encode_batch_fast(texts, **kwargs)

    encoder = encoding.SpacedEncoder(PATH)
    encoder.merges = Recorder(encoder.merges)
    texts = ["Word. word, word! word 12 word? Àword.", "", "word's\nword, \u3000word", "word <|endoftext|>word"]
    ids, sizes = encoder.encode(texts)
    assert [list(x) for x in np.split(ids, np.cumsum(sizes))[: len(texts)]] == plain(texts)
    runs = [run for text in encoder.merges.sent for run in text.split(encoder.SEPARATOR) if run]
    assert runs and len(runs) == len(set(runs))
