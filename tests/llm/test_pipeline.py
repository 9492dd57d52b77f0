"""The pipeline stage by stage against plain versions of the decisions, and odd tables."""

import re
import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as cp  # noqa: E402
from test_neardup import plain as plain_groups  # noqa: E402
from test_pieces import LIBRARY, score_of  # noqa: E402
from test_pii import plain_spans  # noqa: E402

from redpen.llm import mixing, queries  # noqa: E402
from redpen.session import stage  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, function in cp.STAGES:
        frames.append(stage(function(spark, frames[-1], SF), f"test-{name}"))
    return frames


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_quality(spark, steps):
    kept = {r["doc_id"] for r in queries.op2_kneser_ney_quality(spark, SF).collect() if r["kept"]}
    assert set(texts(steps[1])) == kept and steps[1].columns == cp.COLUMNS
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    assert len(good & kept) >= 0.99 * len(good)


def test_near_duplicates(steps):
    before = texts(steps[1])
    assert texts(steps[2]) == {i: t for i, t in before.items() if plain_groups(before)[i][1] == i} if len(before) < 50 else True
    groups = plain_groups(before)
    assert texts(steps[2]) == {i: t for i, t in before.items() if groups[i][1] == i}


def test_personal_data(steps):
    after = texts(steps[3])
    for i, text in texts(steps[2]).items():
        out, free = [], 0
        for start, kind, end in plain_spans(text):
            if start >= free:
                out += [text[free:start], f"[{kind.upper()}]"]
            free = max(free, end)
        assert after[i] == "".join([*out, text[free:]])
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())


def test_mixing(spark, steps):
    rated = mixing.mix_sources(
        steps[3], mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet")), "doc_id", "text", "domain", cp.SHARES
    ).collect()
    assert set(texts(steps[4])) == {r["doc_id"] for r in rated if r["copies"] > 0}
    assert all(r["copies"] > 0 for r in rated if r["rate"] >= 1)
    marks = {r["doc_id"]: r["domain"] for r in mixing.quality_domains(spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    stays = {d: [r["copies"] > 0 for r in rated if marks.get(r["doc_id"]) == d] for d in ("clean", "toxic")}
    share = {d: sum(x) / len(x) for d, x in stays.items()}
    assert share["clean"] > 0.9 and share["toxic"] < share["clean"]


def test_pieces(steps):
    for r in steps[5].limit(100).collect():
        assert score_of(r["piece_ids"]) == pytest.approx(score_of(LIBRARY.encode(r["text"])), abs=0.05)
        assert re.sub("^ ", "", "".join(LIBRARY.id_to_piece(r["piece_ids"])).replace("▁", " ")) or not r["text"]


def test_run(spark, steps):
    assert {r["doc_id"] for r in cp.run(spark, SF).collect()} == set(texts(steps[5]))


def test_odd_tables(spark):
    cols = "doc_id long, text string, lang string, source string, n_chars long, kept int, rate string, _key int, text_hash long"
    rows = [(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (2, None, None, None, None), (None, "x y", "en", None, 3), (3, "", "en", "s", 0), (4, "q " * 100_000, "fr", "s", 9)]
    docs = spark.createDataFrame([(*r, 1, "x", 1, 1) for r in rows], cols)
    sizes = {}
    for name, function in cp.STAGES:
        sizes[name] = function(spark, docs, "/root/testdata/sf0.001").count()
        assert function(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert sizes["near_duplicates"] == 5 and sizes["personal_data"] == sizes["pieces"] == 6
    assert sizes["quality"] <= 4


def test_mixing_gives_every_copy(spark, tmp_path, monkeypatch):
    words = {"clean": "calm river stone green field", "toxic": "vile scum rage filth spite"}
    rows = [(i, f"{words['clean' if i % 2 else 'toxic']} w{i}", "en", "s", 30) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, words["clean"], "en", "s", 30)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(mixing, "LABELLED", 10)
    # what is fitted on ten rows knows no word: all labelled rows must teach
    monkeypatch.setattr(mixing.mix_sources, "__defaults__", tuple(10 if d == 20_000 else d for d in mixing.mix_sources.__defaults__))
    rated = mixing.mix_sources(docs, mixing.quality_domains(labels), "doc_id", "text", "domain", cp.SHARES, bound=None).collect()
    assert any(r["copies"] > 1 for r in rated)
    got = Counter(r["doc_id"] for r in cp.mixing_stage(spark, docs, str(tmp_path)).collect())
    assert got == Counter({r["doc_id"]: r["copies"] for r in rated if r["copies"]})
