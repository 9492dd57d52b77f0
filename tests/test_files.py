"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from redpen.operators import pairs, ratings, sampling
from redpen.sources import readers, writers


@pytest.fixture
def put(tmp_path):
    def write(name, content, encoding="utf-8"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content.encode(encoding))
        return str(path)

    return write


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_pairs(spark, put):
    path = put("p.tsv", 'Source sentence .\tTarget sentence .\n2nd "source .\t2nd target .')
    assert rows(readers.read_pairs(spark, path), "sources", "target") == [
        (["Source sentence ."], "Target sentence ."), (['2nd "source .'], "2nd target ."),
    ]


def test_quoted_pairs_round_trip(spark, tmp_path):
    given = [('say "hi"', "a\\b"), ("", "x y"), ("c", "tab less")]
    df = spark.createDataFrame(given, "source string, target string")
    writers.write_pairs(df.coalesce(1), str(tmp_path / "out"))
    assert rows(readers.read_quoted_pairs(spark, str(tmp_path / "out")), "source", "target") == given


def test_fusion(spark, put):
    head = "\t".join(readers.FUSION_COLUMNS.split())
    body = "1st sentence and 2nd sentence .\t\t1st inc sent .\t2nd inc sent .\t\t\t\t\nA .\tB .\tC .\tD .\tx\ty\tz\tw"
    got = rows(readers.read_fusion(spark, put("f.tsv", f"{head}\n{body}\n")), "sources", "target")
    assert got == [(["1st inc sent .", "2nd inc sent ."], "1st sentence and 2nd sentence ."), (["C .", "D ."], "A . B .")]


def test_rated(spark, put):
    line = "1 ||| web ||| S\tsum one ||| 1 ||| 2 ||| 6 ||| Most important meaning Flawless language\tsum two ||| 1 ||| 2 ||| 9"
    df = readers.read_rated_rows(spark, [put("a.tsv", line + "\n"), put("b.tsv", line.replace("S", "T", 1) + "\n")])
    out = ratings.explode_rated_summaries(df.withColumn("row_id", F.col("part") * (1 << 40) + F.col("row_id")))
    assert sorted(rows(out, "source", "target", "ratings")) == [
        ("S", "sum one", ["6"]), ("S", "sum two", ["9"]), ("T", "sum one", ["6"]), ("T", "sum two", ["9"]),
    ]


def test_compression_json(spark, put):
    record = {"graph": {"sentence": "Graph \"s\" ."}, "headline": "H", "sentence": "Other"}
    path = put("c.json", "\n\n".join([json.dumps(record, indent=2)] * 2) + "\n\n")
    assert rows(readers.read_compression_json(spark, path), "source", "target") == [('Graph "s" .', "H")] * 2


def test_headlines(spark, put):
    wide = put("w.csv", 'author,date,headlines,read_more,text,ctext\na,d,"Hé, l",r,"Té\nxt",c\n', "ISO-8859-1")
    short = put("s.csv", "headlines,text\nH2,T2\n", "ISO-8859-1")
    assert sorted(rows(readers.read_headline_csvs(spark, wide, short), "source", "target")) == [("T2", "H2"), ("Té\nxt", "Hé, l")]


def test_title_tldr(spark, put):
    path = put("r.json", '{"tldr": "long", "title": "short", "x": 1}\n')
    assert rows(readers.read_title_tldr(spark, path), "source", "target") == [("long", "short")]


def test_acceptability(spark, put):
    assert rows(readers.read_acceptability(spark, put("c.tsv", "p\t0\t*\tsample one\np\t1\t\tsample two\n")), "text", "label") == [
        ("sample one", 0), ("sample two", 1),
    ]


def test_labelled_layouts(spark, put):
    read = lambda layout, split, content: rows(
        readers.read_labelled_pairs(spark, put(f"{layout}-{split}.tsv", content), layout, split), "text_a", "text_b", "label"
    )
    assert read("nli_zh", "train", "premise\thypo\tlabel\na\tb\tcontradictory\nc\td\tneutral\n") == [
        ("a", "b", "contradiction"), ("c", "d", "neutral"),
    ]
    dev = "language\tgold\t\t\t\t\ts1\ts2\nzh\tneutral\t\t\t\t\ta\tb\nde\tneutral\t\t\t\t\tc\td\n"
    assert read("nli_zh", "dev", dev) == [("a", "b", "neutral")]
    mnli = "\t".join("0123456789") + "\n" + "\t".join(["x"] * 8 + ["a", "b", "entailment"]) + "\n"
    assert read("mnli", "train", mnli) == [("a", "b", "entailment")]
    assert read("mnli", "test", mnli) == [("a", "b", "contradiction")]
    assert read("mrpc", "train", "q\ti\tj\ta\tb\n1\t2\t3\ta\tb\n") == [("a", "b", "1")]
    assert read("cola", "train", "s\t1\t*\tno header\n") == [("no header", None, "1")]
    assert read("cola", "test", "id\tsentence\n0\ttext\n") == [("text", None, "0")]


def test_reviews(spark, put, tmp_path):
    put("r/pos/1_8.txt", "good\nfilm")
    put("r/neg/22_3.txt", "bad")
    df = readers.read_review_dir(spark, str(tmp_path / "r"))
    assert sorted(rows(df, "sentence", "sentiment", "polarity")) == [("bad", "3", 0), ("good\nfilm", "8", 1)]
    assert sampling.sample_rows(df, 1, "file", 3).count() == 1


def test_qa(spark, put):
    qas = [
        {"id": "a", "question": "q?", "is_impossible": False, "answers": [{"text": "x", "answer_start": 3}]},
        {"id": "b", "question": "r?", "is_impossible": True, "answers": []},
    ]
    path = put("q.json", json.dumps({"data": [{"paragraphs": [{"context": "abcx", "qas": qas}]}]}, indent=1))
    got = rows(readers.read_qa_json(spark, path, True, True), "question_id", "is_impossible", "answer_text", "answer_start")
    assert sorted(got) == [("a", False, "x", 3), ("b", True, "", None)]
    assert readers.read_qa_json(spark, path, False).count() == 2
    with pytest.raises(Exception, match="exactly one answer"):
        readers.read_qa_json(spark, path, True, False).collect()


def test_predictions(spark, put):
    path = put("p.tsv", "source\tpred\ttarget1\ttarget2\nSource2\tpRed2\ttarGet3\n")
    assert rows(readers.read_predictions(spark, path, True), "source", "prediction", "targets") == [
        ("source", "pred", ["target1", "target2"]), ("source2", "pred2", ["target3"]),
    ]
    classes = put("c.tsv", "text\t0\t1\ta\nx\ty\t1\t0\n".replace("\ta\n", "\n"))
    assert rows(readers.read_class_predictions(spark, classes), "prediction", "target") == [(0, 1), (1, 0)]


def test_keywords(spark, put):
    path = put("k.tsv", "Original\tModel1\tModel2\nObject1\tC1\tC1\nObject3\tC1\t\n")
    df, models = readers.read_keyword_table(spark, path)
    assert models == ["Model1", "Model2"]
    assert rows(df, "keyword", *models) == [("Object1", "C1", "C1"), ("Object3", "C1", "")]


def test_sentence_documents(spark, put):
    a = put("d1.txt", "One .\nTwo .\n\nThree .\n  \t\nFour .\n\n\n Five . \n")
    b = put("d2.txt", "Six .")
    df = readers.read_sentence_documents(spark, f"{a},{b}")
    assert sorted(r[0] for r in rows(df, "sentences")) == [["Five ."], ["Four ."], ["One .", "Two ."], ["Six ."], ["Three ."]]


def test_bar_pairs(spark, put):
    assert rows(readers.read_bar_pairs(spark, put("b.txt", "a ||| b ||| c\nalone\n")), "text_a", "text_b") == [
        ("a ||| b", "c"), ("alone", None),
    ]


def test_label_maps(spark, put):
    want = {("KEEP", 0), ("DELETE", 1)}
    assert set(rows(readers.read_label_map(spark, put("m.json", '{"KEEP": 0, "DELETE": 1}')), "tag", "tag_id")) == want
    assert set(rows(readers.read_label_map(spark, put("m.txt", "KEEP\nDELETE\n\n")), "tag", "tag_id")) == want
    with pytest.raises(ValueError):
        readers.read_label_map(spark, put("bad.txt", "KEEP\n\nDELETE\n\n\n"))


def test_vocab(spark, put):
    got = dict(rows(readers.read_vocab(spark, put("v.txt", "a\n b \na\nc\n")), "token", "token_id"))
    assert got == {"a": 2, "b": 1, "c": 3}


def test_class_rows(spark, put):
    assert rows(readers.read_class_rows(spark, put("g.tsv", "x y\t1\n"), "grammar"), "text", "label") == [("x y", 1)]
    meaning = put("m.tsv", "s\tt\t0\nbroken\t1\n")
    assert rows(readers.read_class_rows(spark, meaning, "meaning"), "source", "summary", "label") == [("s", "t", 0)]


def test_splits(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("s"), "id").alias("source"), F.lit("t").alias("target"))
    done = sampling.split_dataset(df, 10, 20, "id", shuffle_all=True, seed=1)
    for fmt in ("parquet", "csv"):
        writers.write_splits(done, str(tmp_path / fmt), fmt)
        back = spark.read.format(fmt).load(str(tmp_path / fmt))
        assert {r["split"]: r["count"] for r in back.groupBy("split").count().collect()} == {"tune": 10, "valid": 20, "train": 70}


def test_label_map_and_log(spark, tmp_path):
    labels = spark.createDataFrame([("KEEP|a", 2), ("KEEP", 0), ("DELETE", 1)], "tag string, tag_id int")
    writers.write_label_map(labels, str(tmp_path / "map"))
    back = readers.read_label_map(spark, str(tmp_path / "map"))
    assert set(rows(back, "tag", "tag_id")) == {("KEEP", 0), ("DELETE", 1), ("KEEP|a", 2)}
    curve = spark.createDataFrame([(1, 5, 12.5, "a b")], "k int, freq long, coverage double, phrase string")
    writers.write_coverage_log(curve, str(tmp_path / "log"))
    text = "".join(p.read_text() for p in (tmp_path / "log").glob("*.csv"))
    assert text.splitlines() == ["Idx\tFrequency\tCoverage (%)\tPhrase", "1\t5\t12.50\ta b"]


def test_features_count(spark, tmp_path):
    assert writers.write_features(spark.range(42), str(tmp_path / "f")) == 42


def test_prediction_and_score_tables(spark, tmp_path):
    wide = spark.createDataFrame([(2, "b", "x", 't "q"'), (1, "a", "", "u")], "row_id long, original string, m1 string, target string")
    writers.write_prediction_table(wide.coalesce(1), str(tmp_path / "w"))
    back = spark.read.csv(str(tmp_path / "w"), header=True, sep="\t", quote='"', escape='"')
    assert [r.original for r in back.collect()] == ["a", "b"] and back.collect()[1].target == 't "q"'
    report = spark.createDataFrame([("m1", 1.0, 2.0, 3.0, 4.0, 5.0)], "model string, exact double, sari double, keep double, addition double, deletion double")
    writers.write_score_table(report, ["m1"], str(tmp_path / "s"))
    got = spark.read.csv(str(tmp_path / "s"), header=True, sep="\t").collect()
    assert [(r.score, r.m1) for r in got] == [
        ("Exact score", "1.0"), ("SARI score", "2.0"), ("KEEP score", "3.0"), ("ADDITION score", "4.0"), ("DELETION score", "5.0"),
    ]


def test_clusters_file(spark, tmp_path):
    members = spark.createDataFrame([("m", "s", 2, 1, "k1"), ("m", "s", 2, 2, "k2")], "model string, short string, size long, row_id long, keyword string")
    writers.write_clusters(members, str(tmp_path / "c"))
    assert (tmp_path / "c" / "model=m").is_dir()
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_qa_files(spark, tmp_path):
    nbest = spark.createDataFrame([(1, 2, "b", 0.1, 0.0, 0.3), (1, 1, "a", 1.0, 0.0, 0.7)], "question_id long, rank int, text string, start_logit double, end_logit double, probability double")
    answers = spark.createDataFrame([(1, "a", -0.5)], "question_id long, answer string, score_diff double")
    writers.write_qa_predictions(nbest, answers, str(tmp_path / "q"))
    r = spark.read.json(str(tmp_path / "q" / "nbest")).first()
    assert [e.text for e in r.nbest] == ["a", "b"]


def test_class_mix_and_probabilities(spark, tmp_path):
    df = spark.createDataFrame([("s", "t", 1, 0, "train"), ("u", "v", 0, 1, "tune")], "source string, target string, grammar int, meaning int, split string")
    writers.write_class_mix(df, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m" / "meaning"), sep="\t").count() == 2
    probs = spark.createDataFrame([(1, [0.25, 0.75], 1), (2, [0.5, 0.5], 0)], "row_id long, probabilities array<double>, is_real_example int")
    writers.write_probabilities(probs, str(tmp_path / "p"))
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["0.25\t0.75"]


def test_requests_stream(spark, tmp_path):
    """The request path runs unchanged on a stream of files."""
    from redpen.operators.features import PieceVocabulary
    from redpen.plans.predict_queries import stand_in_classifier
    from redpen.streaming.requests import answer_requests

    tokens = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "b", "."]
    vocab = PieceVocabulary(spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, token_id int"))
    labels = spark.createDataFrame([("KEEP", 0), ("DELETE", 1)], "tag string, tag_id int")

    def drop_b():
        return lambda frame: [[1 if i == 5 else 0 for i in ids] for ids in frame["input_ids"]]

    spark.createDataFrame([(1, "a  b a."), (2, " "), (3, "b a")], "row_id long, source string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("row_id long, source string").parquet(str(tmp_path / "in"))
    out = answer_requests(stream, drop_b, stand_in_classifier, vocab, labels, 16)
    query = (
        out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(rows(got, "row_id", "prediction", "quality")) == [(1, "a a.", 0), (3, "a", 0)]


def test_drop_empty_on_stream(spark, tmp_path):
    spark.createDataFrame([("a", "b"), (" ", "c")], "source string, target string").write.parquet(str(tmp_path / "in"))
    stream = pairs.drop_empty_pairs(spark.readStream.schema("source string, target string").parquet(str(tmp_path / "in")))
    query = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_nested_files_grow_in_number(spark, monkeypatch):
    from pathlib import Path

    from redpen.plans import file_queries

    paths, staged = [], file_queries.staged_path
    monkeypatch.setattr(file_queries, "staged_path", lambda *a: paths.append(staged(*a)) or paths[-1])
    sf = "/root/testdata/sf0.001"
    found = []
    for size in (16 << 20, 8 << 10):
        monkeypatch.setattr(file_queries, "QA_FILE_BYTES", size, raising=False)
        found.append(sorted(map(str, file_queries.read_qa_json(spark, sf).collect())))
    few, many = ([f.stat().st_size for f in Path(p).rglob("*.txt")] for p in paths)
    assert found[0] == found[1]
    assert len(few) <= 16 < len(many) and max(many) < max(few)
