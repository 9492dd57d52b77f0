"""Packing: the placement rule by trying all levels, ids against the library, whole results of the query."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from redpen.llm import packing
from redpen.llm.queries import op11_sum_of_squares_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


LIBRARY, ENCODER = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)


def plain(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \t\n\x1c\x85aBσΣİé́1.'<|>", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]), max_size=30).map("".join), max_size=4))
def test_ids_of_whole_texts(texts):
    ids, sizes = ENCODER.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[: len(texts)]] == plain(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 15), max_size=80))
def test_level_by_trying_all(lengths):
    packer = packing.Packer(16, most_open=1000)
    levels = []  # fill of every open window
    for n in lengths:
        def cost(level):
            after = Counter(levels)
            if level:
                after[level] -= 1
            after[level + n] += level + n < 16
            return sum(c * c for c in after.values())

        best = max([0, *[x for x in levels if x + n <= 16]], key=lambda x: (-cost(x), x))
        assert packer.level_for(n) == best
        packer.add((0, 0, n, np.arange(n, dtype=np.uint32)))
        if best:
            levels.remove(best)
        levels += [best + n] if best + n < 16 else []
        assert packer.n_open == len(levels)


@pytest.mark.parametrize("most_open", [3, 50])
def test_settling_keeps_every_id(most_open):
    rng = random.Random(most_open)
    packer, windows, want = packing.Packer(64, most_open), [], []
    for doc in range(500):
        n = rng.choice([40, 40, 40, rng.randint(1, 63)])
        ids = np.arange(n, dtype=np.uint32) + 1000 * doc
        want += ids.tolist()
        windows += packer.add((doc, 0, n, ids))
        assert packer.n_open <= most_open
    windows += packer.settle()
    assert packer.n_open <= 1 and all(sum(len(p[3]) for p in w) == 64 for w in windows)
    tail = list(packing.powers(packer.rest()))
    lengths = [sum(len(p[3]) for p in w) for w in tail]
    assert all(n & (n - 1) == 0 for n in lengths) and lengths == sorted(set(lengths), reverse=True)
    pieces = [p for w in windows + tail for p in w]
    assert all(len(p[3]) and p[1] == p[3][0] - 1000 * p[0] for p in pieces)
    assert sorted(i for p in pieces for i in p[3].tolist()) == sorted(want)


def check(rows, docs):
    """Every id in one piece, sequences without gaps, no padding; ``docs`` counts (doc_id, ids)."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == 2048 or at < 2048 and at & (at - 1) == 0
    for doc, ids in docs:
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    return by_sequence


def test_query_against_plain_encoding(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = [(d, [*ids, 1]) for (d, _), ids in zip(docs, plain([t or "" for _, t in docs]))]
    found = check(op11_sum_of_squares_packing(spark, sf).collect(), want)
    assert len(found) <= sum(len(ids) for _, ids in want) / 2048 + 12


def test_odd_tables(spark):
    rows = [(3, "b c", 1, None), (1, None, 1, 2), (None, "n <|endoftext|>", 1, 2), (2, "", 1, 2), (9, "wo rd " * 60_000, 1, 2), (4, "a " * 2047, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long, shard int").repartition(3)
    packed = packing.pack_documents(docs, "doc_id", "text", PATH)
    assert packed.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    got = [{**r.asDict(), "ids_crc32": zlib.crc32(r["ids"])} for r in packed.collect()]
    check(got, [(r[0], [*ids, 1]) for r, ids in zip(rows, plain([r[1] or "" for r in rows]))])


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "same words here")] * 50, "doc_id long, text string").repartition(2)
    got = packing.pack_documents(docs, "doc_id", "text", PATH).collect()
    assert sum(r["length"] for r in got) == 50 * 4 and {r["doc_tokens"] for r in got} == {4}
    assert packing.pack_documents(docs.limit(0), "doc_id", "text", PATH).count() == 0


def test_many_tasks_leave_few_short_windows(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('some words ', cast(id % 900 as int)) text").repartition(40)
    got = packing.pack_documents(docs, "doc_id", "text", PATH).collect()
    sizes = Counter()
    for r in got:
        sizes[r["sequence_id"]] += r["length"]
    assert sum(n < 2048 for n in sizes.values()) <= 11
