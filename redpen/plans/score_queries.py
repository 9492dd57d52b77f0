"""Queries on scores and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpen.operators import clusters, scoring
from redpen.plans import views as v
from redpen.plans.pair_queries import _rounded


def exact_score(spark, sf):
    return _rounded(scoring.exact_score(v.predictions(spark, sf), ["model"]))


EXACT = f"""WITH {v.PREDICTIONS} SELECT model, round(avg(list_contains(targets, prediction)::INT), 6) AS exact
FROM predictions GROUP BY model"""


def sari_rows(spark, sf):
    rows = scoring.lowercase_columns(v.predictions(spark, sf))
    return _rounded(scoring.sari_rows(rows, ["row_id", "model"]))


# grams are exploded with a flag per side; the weight is the share of non-empty targets
_SARI = f"""WITH {v.PREDICTIONS}, sides AS (
  SELECT row_id, model, 's' AS side, {v.sql_tokens('lower(source)')} AS toks FROM predictions
  UNION ALL SELECT row_id, model, 'p', {v.sql_tokens('lower(prediction)')} FROM predictions
  UNION ALL SELECT row_id, model, 't' || i, {v.sql_tokens('lower(targets[i])')}
  FROM predictions, (VALUES (1), (2)) AS k(i)), positions AS (
  SELECT row_id, model, side, n, toks, unnest(range(1, len(toks) - n + 2)) AS i FROM sides, (VALUES (1), (2), (3), (4)) AS g(n)), grams AS (
  SELECT DISTINCT row_id, model, side, n, array_to_string(toks[i:i + n - 1], ' ') AS gram FROM positions), targets AS (
  SELECT row_id, model, n, count(DISTINCT side) AS m FROM grams WHERE side[1] = 't' GROUP BY ALL), flags AS (
  SELECT row_id, model, n, gram, max((side = 's')::INT) AS s, max((side = 'p')::INT) AS p,
         count(*) FILTER (side[1] = 't') / coalesce(max(t.m), 1) AS w
  FROM grams LEFT JOIN targets t USING (row_id, model, n) GROUP BY ALL), sums AS (
  SELECT row_id, model, n, sum(w) FILTER (s = 1 AND p = 1) AS ktp, count(*) FILTER (s = 1 AND p = 1) AS ksel,
    sum(w) FILTER (s = 1) AS krel, sum(1 - w) FILTER (s = 1 AND p = 0) AS dtp, count(*) FILTER (s = 1 AND p = 0) AS dsel,
    sum(1 - w) FILTER (s = 1) AS drel, count(*) FILTER (p = 1 AND s = 0 AND w > 0) AS atp,
    count(*) FILTER (p = 1 AND s = 0) AS asel, count(*) FILTER (w > 0 AND s = 0) AS arel
  FROM flags GROUP BY ALL), ratios AS (
  SELECT row_id, model, n, CASE WHEN ksel > 0 THEN coalesce(ktp, 0) / ksel ELSE 1 END AS kp,
    CASE WHEN coalesce(krel, 0) > 1e-9 THEN coalesce(ktp, 0) / krel ELSE 1 END AS kr,
    CASE WHEN dsel > 0 THEN coalesce(dtp, 0) / dsel ELSE 1 END AS dp,
    CASE WHEN coalesce(drel, 0) > 1e-9 THEN coalesce(dtp, 0) / drel ELSE 1 END AS dr,
    CASE WHEN asel > 0 THEN atp / asel ELSE 1 END AS ap, CASE WHEN arel > 0 THEN atp / arel ELSE 1 END AS ar
  FROM sums), scores AS (
  SELECT row_id, model, n, CASE WHEN kp > 1e-9 AND kr > 1e-9 THEN 2 * kp * kr / (kp + kr) ELSE 0 END AS k,
    CASE WHEN dp > 1e-9 AND dr > 1e-9 THEN 2 * dp * dr / (dp + dr) ELSE 0 END AS d,
    CASE WHEN ap > 0 AND ar > 0 THEN 2 * ap * ar / (ap + ar) ELSE 0 END AS a
  FROM ratios), sari AS (
  SELECT row_id, model, (sum(coalesce(k, 1))) / 4 AS keep, sum(coalesce(a, 1)) / 4 AS addition, sum(coalesce(d, 1)) / 4 AS deletion
  FROM (SELECT row_id, model, n FROM predictions, (VALUES (1), (2), (3), (4)) AS g(n)) LEFT JOIN scores USING (row_id, model, n)
  GROUP BY ALL)"""
SARI = _SARI + """ SELECT row_id, model, round(keep, 6) AS keep, round(addition, 6) AS addition,
  round(deletion, 6) AS deletion, round((keep + addition + deletion) / 3, 6) AS sari FROM sari"""


def score_report(spark, sf):
    return scoring.score_report(scoring.lowercase_columns(v.prediction_lists(spark, sf)))


SCORE_REPORT = _SARI + """ SELECT model, round(avg(list_contains(list_transform(targets, lambda t: lower(t)), lower(prediction))::INT) * 100, 3) AS exact,
  round(avg((keep + addition + deletion) / 3) * 100, 3) AS sari, round(avg(keep) * 100, 3) AS keep,
  round(avg(addition) * 100, 3) AS addition, round(avg(deletion) * 100, 3) AS deletion
FROM predictions JOIN sari USING (row_id, model) GROUP BY model"""


# per token: true and predicted kind (0 deleted, 1 kept, 2 replaced) from two hashes
def _kind(seed, key, i):
    d = v.digit(seed, 1, key, i)
    return F.when(d < "3", 0).when(d == "3", 2).otherwise(1)


def _sql_kind(seed, key="pair_id"):
    d = f"substr(md5(concat('{seed}:', {key}, ':', i - 1)), 1, 1)"
    return f"CASE WHEN {d} < '3' THEN 0 WHEN {d} = '3' THEN 2 ELSE 1 END"


def _token_labels(spark, sf):
    key = F.col("pair_id")
    return v.lines(spark, sf).select(
        key,
        F.transform("toks", lambda t, i: _kind(7, key, i)).alias("labels"),
        F.transform("toks", lambda t, i: _kind(7, key, i) * F.when(v.digit(41, 1, key, i) == "0", 0).otherwise(1)).alias("predicted"),
        F.transform("toks", lambda t: F.when(t.rlike(r"^\p{P}+$"), 0).otherwise(1)).alias("mask"),
        F.transform("toks", lambda t: 1.0 / F.length(t)).alias("losses"),
        (F.lit(1.0) / F.size("toks")).alias("loss"),
    )


_TOKEN_LABELS = f"""{v.LINES}, token_labels AS (
  SELECT pair_id, list_transform(toks, lambda t, i: {_sql_kind(7)}) AS labels,
    list_transform(toks, lambda t, i: ({_sql_kind(7)}) * CASE WHEN substr(md5(concat('41:', pair_id, ':', i - 1)), 1, 1) = '0' THEN 0 ELSE 1 END) AS predicted,
    list_transform(toks, lambda t: CASE WHEN regexp_full_match(t, '\\p{{P}}+') THEN 0 ELSE 1 END) AS mask,
    list_transform(toks, lambda t: 1.0::DOUBLE / length(t)) AS losses, 1.0::DOUBLE / len(toks) AS loss FROM lines)"""


def sequence_accuracy(spark, sf):
    return _rounded(scoring.sequence_accuracy(_token_labels(spark, sf), "labels", "predicted", "mask", "loss"))


SEQUENCE = f"""WITH {_TOKEN_LABELS} SELECT round(avg((len(list_filter(range(1, len(labels) + 1),
  lambda i: mask[i] = 1 AND labels[i] <> predicted[i])) = 0)::INT), 6) AS accuracy, round(avg(loss), 6) AS loss FROM token_labels"""


def weighted_token_accuracy(spark, sf):
    return _rounded(scoring.weighted_token_accuracy(_token_labels(spark, sf), "labels", "predicted", "mask", "losses"))


WEIGHTED = f"""WITH {_TOKEN_LABELS}, t AS (SELECT unnest(labels) AS l, unnest(predicted) AS p, unnest(mask) AS w, unnest(losses) AS x FROM token_labels)
SELECT round(sum(CASE WHEN l = p THEN w ELSE 0 END) / sum(w)::DOUBLE, 6) AS accuracy, round(sum(w * x) / sum(w), 6) AS loss,
  sum(w)::DOUBLE AS weight FROM t"""


def example_accuracy(spark, sf):
    rows = v.table(spark, sf, "embeddings").select(
        "label", F.col("embedding").alias("scores"),
        F.abs(F.get("embedding", F.lit(0))).cast("double").alias("loss"),
        (F.get("embedding", F.lit(1)) > 0).cast("int").alias("is_real_example"),
    )
    return _rounded(scoring.example_accuracy(rows, "scores", "label", "loss"))


EXAMPLE = """SELECT round(sum((list_position(embedding, list_max(embedding)) - 1 = label)::INT * w) / sum(w), 6) AS accuracy,
  round(sum(abs(embedding[1])::DOUBLE * w) / sum(w), 6) AS loss
FROM (SELECT embedding, label, (embedding[2] > 0)::INT AS w FROM embeddings)"""


def class_report(spark, sf):
    return _rounded(scoring.class_report(v.class_predictions(spark, sf)))


CLASS_REPORT = f"""WITH {v.CLASS_PREDICTIONS}, c AS (
  SELECT k AS class, count(*) FILTER (target = k) AS support, count(*) FILTER (prediction = k) AS selected,
         count(*) FILTER (target = k AND prediction = k) AS tp
  FROM class_predictions, (SELECT DISTINCT target AS k FROM class_predictions) GROUP BY k), r AS (
  SELECT class, support, CASE WHEN tp > 0 THEN tp / selected ELSE 0 END AS p, CASE WHEN tp > 0 THEN tp / support ELSE 0 END AS r FROM c)
SELECT class, support, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r"""


def class_accuracy(spark, sf):
    return _rounded(scoring.accuracy(v.class_predictions(spark, sf)))


CLASS_ACCURACY = f"WITH {v.CLASS_PREDICTIONS} SELECT round(avg((target = prediction)::INT), 6) AS accuracy FROM class_predictions"


def binary_metrics(spark, sf):
    return _rounded(scoring.binary_metrics(v.class_predictions(spark, sf), "prediction", "target"))


BINARY = f"""WITH {v.CLASS_PREDICTIONS}, c AS (
  SELECT count(*) FILTER (prediction = 1 AND target = 1) AS tp, count(*) FILTER (prediction = 0 AND target = 0) AS tn,
         count(*) FILTER (prediction = 1 AND target = 0) AS fp, count(*) FILTER (prediction = 0 AND target = 1) AS fn FROM class_predictions)
SELECT tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
  round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""


def roc_auc(spark, sf):
    rows = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    return _rounded(scoring.roc_auc(rows.select("n_chars", "quality"), "n_chars", "quality"))


ROC_AUC = """WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r
  FROM documents JOIN labels USING (doc_id))
SELECT round((sum(r) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2)
  / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)), 6) AS auc FROM r"""


def _long(spark, sf):
    return clusters.unpivot_models(v.keywords(spark, sf), ["m1", "m2"])


def keyword_clusters(spark, sf):
    return clusters.keyword_clusters(_long(spark, sf))


CLUSTERS = f"""WITH {v.KEYWORDS} SELECT model, short, size, row_id, keyword FROM (
  SELECT *, count(*) OVER (PARTITION BY model, short) AS size FROM keywords WHERE short <> '') WHERE size > 1"""


def cluster_summary(spark, sf):
    return clusters.cluster_summary(_long(spark, sf))


CLUSTER_SUMMARY = f"""WITH {v.KEYWORDS}, s AS (SELECT model, short, count(*) AS size FROM keywords GROUP BY ALL)
SELECT model, coalesce(sum(size) FILTER (size > 1 AND short <> ''), 0)::BIGINT AS clustered, sum(size)::BIGINT AS total FROM s GROUP BY model"""


QUERIES = {
    "exact_score": (exact_score, EXACT),
    "sari_rows": (sari_rows, SARI),
    "score_report": (score_report, SCORE_REPORT),
    "sequence_accuracy": (sequence_accuracy, SEQUENCE),
    "weighted_token_accuracy": (weighted_token_accuracy, WEIGHTED),
    "example_accuracy": (example_accuracy, EXAMPLE),
    "class_report": (class_report, CLASS_REPORT),
    "class_accuracy": (class_accuracy, CLASS_ACCURACY),
    "binary_metrics": (binary_metrics, BINARY),
    "roc_auc": (roc_auc, ROC_AUC),
    "keyword_clusters": (keyword_clusters, CLUSTERS),
    "cluster_summary": (cluster_summary, CLUSTER_SUMMARY),
}
