"""Ranks, dense numbers, hot keys and plans: what has to hold when tables grow and keys are skewed."""

import glob
import os
import random
import re
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from redpen import session
from redpen.functions.hashing import ORDER_KEY_MAX, order_key
from redpen.operators import clusters, features, lookup, ranking, sampling, scoring, vocabulary
from redpen.plans.catalog import CATALOG

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_limits(monkeypatch):
    """Few slices and small edges, so that the narrowing really takes several passes."""
    monkeypatch.setattr(ranking, "BUCKETS", 4)
    monkeypatch.setattr(ranking, "EDGE_ROWS", 3)
    monkeypatch.setattr(ranking, "HOT_KEYS", 2)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id bigint")


@pytest.mark.parametrize("n", [1, 2, 50, 99, 100])
def test_nth_lowest(spark, small_limits, n):
    rng = random.Random(n)
    values = [rng.randrange(-1000, 1 << 40) for _ in range(99)] + [1 << 60]
    edge = ranking.nth_lowest(ids(spark, values), F.col("id"), "id", [n], min(values), max(values))[0]
    assert edge[0] == sorted(values)[n - 1]


def test_nth_lowest_with_equal_ranks(spark, small_limits):
    edge = ranking.nth_lowest(ids(spark, range(100)), F.lit(5).cast("bigint"), "id", [40, 100], 0, 1000)
    assert edge == [(5, 39), (5, 99)]
    with pytest.raises(ValueError):
        ranking.nth_lowest(ids(spark, range(100)), F.col("id"), "id", [101], 0, 99)


def test_split_counts_and_errors(spark):
    df = ids(spark, range(5)).withColumn("source", F.lit("s"))
    done = sampling.split_dataset(df, 1, 2, "id")
    assert {(r.id, r.split) for r in done.collect()} == {(0, "tune"), (1, "valid"), (2, "valid"), (3, "train"), (4, "train")}
    shuffled = sampling.split_dataset(df, 1, 2, "id", shuffle_all=True, seed=2)
    assert {r["split"]: r["count"] for r in shuffled.groupBy("split").count().collect()} == {"tune": 1, "valid": 2, "train": 2}
    assert {r.split for r in sampling.split_dataset(df, 0, 0, "id").collect()} == {"train"}
    with pytest.raises(ValueError):
        sampling.split_dataset(df, 5, 5, "id")


def test_mix_to_ratio(spark):
    base = ids(spark, range(500)).withColumn("label", F.lit(0))
    extra = ids(spark, range(1200)).withColumn("label", (F.col("id") >= 600).cast("int"))
    mixed = sampling.mix_to_ratio(base, extra, 0.8, "id")
    counts = {r.label: r["count"] for r in mixed.groupBy("label").count().collect()}
    assert counts == {0: 1100, 1: 274}
    assert sampling.mix_to_ratio(base, extra, None, "id").filter("label = 1").count() == 0
    for goal in (0.1, 1.1):
        with pytest.raises(ValueError):
            sampling.mix_to_ratio(base, extra, goal, "id")


def test_mix_negatives(spark):
    assert sampling.negatives_needed(50, 110, 0.8) == 190
    base = ids(spark, range(110)).withColumns({"label": (F.col("id") >= 50).cast("int"), "text": F.lit("t")})
    made = ids(spark, range(300)).withColumn("text", F.lit("m"))
    mixed = sampling.mix_negatives(base, made, 0.8, "id", ["text"])
    assert mixed.filter("label = 0").count() == 240 and mixed.count() == 300
    with pytest.raises(ValueError):
        sampling.mix_negatives(base, made, 0.95, "id", ["text"])
    with pytest.raises(ValueError):
        sampling.mix_negatives(base, made, 0.1, "id", ["text"])


@pytest.mark.parametrize("rows, batch, padded", [(5, 4, 8), (8, 4, 8), (1, 7, 7)])
def test_pad(spark, rows, batch, padded):
    out = sampling.pad_to_batch(ids(spark, range(rows)), batch)
    assert out.count() == padded and out.filter("is_real_example = 1").count() == rows


def test_dense_index(spark):
    rows = ranking.dense_index(ids(spark, range(0, 5000, 7)), "id", 3).collect()
    assert sorted(r.idx for r in rows) == list(range(len(rows)))
    assert {r.idx_n for r in rows} == {len(rows)}


def test_clusters_with_a_hot_form(spark, small_limits):
    """A third of the rows share one form; several others tie for the last broadcast place."""
    forms = ["hot"] * 100 + [f"f{i % 60}" for i in range(120)] + ["alone"] + [""] * 80
    df = spark.createDataFrame(list(enumerate(forms)), "row_id bigint, m string").withColumn("keyword", F.concat(F.lit("k"), "row_id"))
    long = clusters.unpivot_models(df, ["m"])
    members = clusters.keyword_clusters(long).collect()
    assert len(members) == 220 and len({r.row_id for r in members}) == 220
    assert {r["size"] for r in members if r.short == "hot"} == {100}
    assert {r["size"] for r in members if r.short != "hot"} == {2}
    s = clusters.cluster_summary(long).first()
    assert (s.clustered, s.total) == (220, len(forms))


def test_cluster_golden(spark):
    rows = [(0, "Object1", "Cluster1", "Cluster1"), (1, "Object2", "cluster1", "Cluster2"), (2, "Object3", "Cluster1", ""), (3, "Object4", "x", "Cluster2")]
    df = spark.createDataFrame(rows, "row_id bigint, keyword string, Model1 string, Model2 string")
    got = {}
    for r in clusters.keyword_clusters(clusters.unpivot_models(df, ["Model1", "Model2"])).orderBy("row_id").collect():
        got.setdefault((r.model, r.short), []).append(r.keyword)
    assert got == {("Model1", "cluster1"): ["Object1", "Object2", "Object3"], ("Model2", "cluster2"): ["Object2", "Object4"]}


def test_auc_against_all_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(40) / 10, rng.randrange(2)) for _ in range(400)]
    got = scoring.roc_auc(spark.createDataFrame(rows, "s double, t int"), "s", "t").first().auc
    pos, neg = [s for s, t in rows if t], [s for s, t in rows if not t]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert got == pytest.approx(won / (len(pos) * len(neg)))


def test_binary_metrics(spark):
    rows = [(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4
    m = scoring.binary_metrics(spark.createDataFrame(rows, "p int, t int"), "p", "t").first()
    assert (m.tp, m.fp, m.fn, m.tn) == (3, 1, 2, 4)
    assert (m.accuracy, m.precision, m.recall) == (0.7, 0.75, 0.6)


def test_order_key_range(spark):
    r = spark.range(1000).agg(F.min(order_key(1, F.col("id"))), F.max(order_key(1, F.col("id")))).first()
    assert 0 <= r[0] < r[1] <= ORDER_KEY_MAX


ROW_LOCAL = [
    "clean_text", "drop_empty_pairs", "tokenize_table", "token_table", "mask_tokens", "explode_rated_summaries",
    "filter_low_rated", "rating_labels", "realize", "infeasible_tune", "sentence_segments", "pos_segments",
    "doc_windows", "max_context", "align_answer_span", "char_word_offsets", "pack_sentences", "mask_lm", "sari_rows",
]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_LOCAL)
def test_row_local_queries_do_not_shuffle(spark, name):
    """Nothing but the spreading of a one-file input may move rows."""
    exchanges = re.findall(r"Exchange \w+.*", plan_of(CATALOG[name][0](spark, SF)))
    assert all("REPARTITION_BY_NUM" in e for e in exchanges)


@pytest.mark.parametrize("name", [n for n in CATALOG if n not in ("mined_vocabulary", "training_instances")])
def test_no_cross_join(spark, name):
    plan = plan_of(CATALOG[name][0](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["predict_table", "attach_quality_label"])
def test_models_run_once(spark, name):
    """Each predictor and kernel is called in one place of the plan."""
    calls = re.findall(r"(?:ArrowEvalPython|BatchEvalPython) \[(.*?)\], \[", plan_of(CATALOG[name][0](spark, SF)))
    names = [re.match(r"\w+", c)[0] for c in calls]
    assert names.count("predict") == (2 if name == "attach_quality_label" else 1)


def test_long_rows_of_pieces(spark):
    began = time.perf_counter()
    rows = spark.createDataFrame([(["a", ".", "b"] * 60_000,), ([],), (None,), (["!", "x"],)], "p array<string>")
    got = [r[0] for r in rows.select(features.sentence_segments(F.col("p"))).collect()]
    assert got[0][:7] == [0, 0, 1, 1, 1, 0, 0] and got[1] == [] and got[3] == [0, 1]
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("keys", [[i % 3 for i in range(30)], [None] * 7 + [1] * 13 + [2] * 10, [-(2**63)] * 3 + [2**63 - 1] * 27])
def test_exact_sizes_with_repeated_keys(spark, keys):
    df = spark.createDataFrame(list(enumerate(keys)), "i int, k long").repartition(4)
    for n, seed in [(1, None), (5, 3), (10, None), (29, 3), (30, None)]:
        got = sampling.sample_rows(df, n, "k", seed).collect()
        assert len(got) == n == len({r.i for r in got})
    for tune, valid, shuffle in [(5, 5, False), (1, 2, True), (10, 20, False), (0, 4, True), (3, 14, False)]:
        sizes = dict(sampling.split_dataset(df, tune, valid, "k", shuffle_all=shuffle).groupBy("split").count().collect())
        assert [sizes.get(s, 0) for s in ("tune", "valid", "train")] == [tune, valid, 30 - tune - valid]


def test_coverage_of_a_vocabulary_that_does_not_travel(spark, monkeypatch):
    mined = spark.createDataFrame([(i, ["a", f"p{i % 5}"]) for i in range(50)], "pair_id bigint, phrases array<string>")
    ranked = vocabulary.phrase_vocabulary(vocabulary.phrase_counts(mined), 4)
    small = [tuple(r) for r in vocabulary.coverage_curve(mined, ranked).orderBy("k").collect()]
    monkeypatch.setattr(lookup, "TRAVEL_BYTES", -1)
    assert [tuple(r) for r in vocabulary.coverage_curve(mined, ranked).orderBy("k").collect()] == small


def test_pushdown(spark):
    plan = plan_of(CATALOG["roc_auc"][0](spark, SF))
    assert "text" not in "".join(re.findall(r"ReadSchema: \S+", plan))


def test_nbest_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(CATALOG["nbest_answers"][0](spark, SF))


def test_split_of_an_empty_table(spark):
    empty = ids(spark, range(3)).filter("id > 5")
    assert sampling.split_dataset(empty, 0, 0, "id").count() == 0
    with pytest.raises(ValueError):
        sampling.split_dataset(empty, 1, 0, "id")


@pytest.mark.parametrize("name", ["exact_score", "score_report", "tag_pairs", "predict_table"])
def test_edited_copies_are_hashed_once(spark, name):
    """Copies come from one kernel per line; as expressions every copy hashed every token again, and lines were cut twice."""
    plan = plan_of(CATALOG[name][0](spark, SF))
    assert "md5(" not in plan
    assert not re.findall(r"Filter .*split\(", plan)


def test_sari_is_one_kernel(spark):
    plan = plan_of(CATALOG["score_report"][0](spark, SF))
    assert "array_intersect" not in plan and "array_except" not in plan


def test_vocabularies_are_made_once(spark):
    """What is measured, sent and looked up is a written table, not the job that makes it."""
    from redpen.plans import edit_queries, feature_queries

    assert "/vocabulary-" in feature_queries.pieces(spark, SF).lookup.table.inputFiles()[0]
    assert "/label-map-" in edit_queries._label_map(spark, SF).inputFiles()[0]


def test_random_partners_are_numbered_first(spark):
    """The joins with the documents' numbers read a written table and wait for no broadcast of their own."""
    plan = plan_of(CATALOG["random_next"][0](spark, SF))
    assert "/numbered-" in plan and "Window" not in plan


def test_staging_leaves_no_shuffle_files(spark):
    def files():
        tops = [os.environ.get("SPARK_LOCAL_DIRS"), spark.conf.get("spark.local.dir", None), tempfile.gettempdir()]
        return {f for top in tops if top for nested in ("", "spark-*/") for f in glob.glob(f"{top}/{nested}blockmgr-*/*/shuffle_*")}

    sums = spark.range(100_000).groupBy(F.xxhash64("id").alias("k")).agg(F.sum("id").alias("s"))
    before = files()
    staged = session.stage(sums, "sums")
    time.sleep(1)  # they are removed in the background
    assert not files() - before
    assert staged.count() == 100_000
    assert sums.count() == 100_000 and files() - before  # a plain run leaves some
