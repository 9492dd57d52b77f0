"""Queries on batch prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpen.functions import text
from redpen.operators import predict
from redpen.plans import views as v
from redpen.plans.edit_queries import _TAG_IDS
from redpen.plans.feature_queries import FEATURE_ROWS, MAX_LEN, pieces
from redpen.plans.pair_queries import _sql_clean, sql_treebank

# label of a piece in the stand-in model, by its id modulo 5
_LABELS = [0, 1, 0, 3, 0]


def stand_in_tagger():
    """A predictor that decides by piece id alone."""
    def model(frame):
        return [[_LABELS[i % 5] for i in ids] for ids in frame["input_ids"]]

    return model


def stand_in_classifier():
    """A predictor that accepts texts of at least twelve pieces."""
    def model(frame):
        return [int(sum(mask) >= 14) for mask in frame["input_mask"]]

    return model


def prepare_inputs(spark, sf):
    return predict.prepare_inputs(v.chat_pairs(spark, sf), True).select("conv_id", "turn", "source", "target")


PREPARE = f"""WITH {v.CHAT_PAIRS}, spaced AS (
  SELECT conv_id, turn, {sql_treebank('(' + _sql_clean('source') + ')')} AS source, {sql_treebank('(' + _sql_clean('target') + ')')} AS target FROM chat_pairs)
SELECT conv_id, turn, source, target FROM spaced WHERE source <> '' AND target <> ''"""


def _label_map(spark):
    return spark.createDataFrame(list(_TAG_IDS.items()), "tag string, tag_id int")


def _predicted(spark, sf, vocab):
    rows = v.fusion(spark, sf).withColumnRenamed("pair_id", "row_id")
    return predict.predict_table(rows, stand_in_tagger, vocab, _label_map(spark), MAX_LEN)


def predict_table(spark, sf):
    return _predicted(spark, sf, pieces(spark, sf)).select("row_id", "prediction")


_BY_ID = " ".join(f"WHEN {i} THEN '{t}'" for t, i in _TAG_IDS.items())
_LABEL_SQL = "[" + ", ".join(map(str, _LABELS)) + "]"
PREDICT = f"""WITH RECURSIVE {FEATURE_ROWS}, firsts AS (
  SELECT pair_id, i, arg_min(token_id, r) AS id, min(r) AS r FROM marked GROUP BY pair_id, i), labelled AS (
  SELECT g.pair_id, g.i, g.token, g.n_one, g.n_two, CASE WHEN r <= {MAX_LEN - 2} THEN {_LABEL_SQL}[id % 5 + 1] ELSE 0 END AS label
  FROM generated g LEFT JOIN firsts f ON f.pair_id = g.pair_id AND f.i = g.i), words AS (
  SELECT pair_id, i, i >= n_one AS late, n_two > 0 AS two, CASE coalesce(label, 0) WHEN 0 THEN token WHEN 3 THEN 'and ' || token END AS w
  FROM labelled), halves AS (
  SELECT pair_id, any_value(two) AS two, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT late), '') AS a,
    coalesce(string_agg(w, ' ' ORDER BY i) FILTER (late), '') AS b FROM words GROUP BY pair_id)
SELECT pair_id AS row_id, CASE WHEN NOT two THEN a WHEN a = '' OR right(a, 1) IN ('.', '!', '?')
  THEN a || ' ' || upper(b[1]) || b[2:] ELSE a || ' ' || lower(b[1]) || b[2:] END AS prediction FROM halves"""


def attach_quality_label(spark, sf):
    vocab = pieces(spark, sf)
    done = predict.attach_quality_label(_predicted(spark, sf, vocab), stand_in_classifier, vocab, MAX_LEN)
    return done.select("row_id", "prediction", "quality")


# pieces of a text are counted over its lower-cased tokens
_HEAD, _TAIL = PREDICT.rsplit("SELECT pair_id AS row_id", 1)
QUALITY = f"""{_HEAD.rstrip()}, predicted AS (SELECT pair_id AS row_id{_TAIL}), low AS (
  SELECT DISTINCT lower(token) AS token, len(pieces) AS n FROM token_pieces), parts AS (
  SELECT row_id, unnest({v.sql_tokens('lower(prediction)')}) AS token FROM predicted), sizes AS (
  SELECT row_id, sum(n) AS n FROM parts JOIN low USING (token) GROUP BY row_id)
SELECT row_id, prediction, (least(coalesce(n, 0), {MAX_LEN - 2}) + 2 >= 14)::INT AS quality FROM predicted LEFT JOIN sizes USING (row_id)"""


def clean_predictions(spark, sf):
    rows = v.predictions(spark, sf).withColumn("prediction", text.treebank(F.col("prediction")))
    return predict.clean_predictions(rows).select("row_id", "model", "prediction")


def sql_detokenised(expr: str) -> str:
    out = f"concat(' ', {expr}, ' ')"
    for pattern, to in text.DETOKENISE_RULES:
        to = to.replace("$", "\\").replace("'", "''")
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), to)
    return f"trim({out})"


# marks stay after the first word unless another mark is just before; quotes never pair; a
# bracket stays when the running balance of its kind closes it, and not before the first word
_MARKS = "',', '.', ':', '!', '?'"
_OPEN, _CLOSE, _QUOTES = "'{', '[', '('", "'}', ']', ')'", "'\"', ''''"
REPAIR = f"""spaced AS (SELECT row_id, model, {v.sql_tokens(sql_treebank('prediction'))} AS toks FROM predictions), words AS (
  SELECT row_id, model, unnest(range(0, len(toks))) AS pos, unnest(toks) AS w FROM spaced), kinds AS (
  SELECT *, CASE w WHEN '}}' THEN '{{' WHEN ']' THEN '[' WHEN ')' THEN '(' ELSE w END AS kind,
    CASE WHEN w IN ({_OPEN}) THEN 1 WHEN w IN ({_CLOSE}) THEN -1 ELSE 0 END AS turn, lag(w) OVER (PARTITION BY row_id, model ORDER BY pos) AS ahead,
    coalesce(min(pos) FILTER (w NOT IN ({_MARKS}, {_OPEN}, {_CLOSE}, {_QUOTES})) OVER (PARTITION BY row_id, model), 1000000000) AS opening FROM words), brackets AS (
  SELECT row_id, model, pos, kind, turn, pos < opening AS early, sum(turn) OVER (PARTITION BY row_id, model, kind ORDER BY pos) AS level FROM kinds WHERE turn <> 0), judged AS (
  SELECT row_id, model, pos, CASE WHEN turn = -1
      THEN NOT early AND level >= least(0, coalesce(min(level) OVER (PARTITION BY row_id, model, kind ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      ELSE coalesce(min(level) OVER (PARTITION BY row_id, model, kind ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), level) < level
        AND NOT (early AND coalesce(min(CASE WHEN early THEN level END) OVER (PARTITION BY row_id, model, kind ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), level) < level)
      END AS stays FROM brackets), kept AS (
  SELECT k.row_id, k.model, k.pos, k.w FROM kinds k LEFT JOIN judged j ON j.row_id = k.row_id AND j.model = k.model AND j.pos = k.pos
  WHERE CASE WHEN k.w IN ({_MARKS}) THEN k.pos > opening AND coalesce(ahead, '') NOT IN ({_MARKS}) WHEN k.w IN ({_QUOTES}) THEN false
    WHEN k.turn <> 0 THEN stays ELSE true END), repaired AS (
  SELECT row_id, model, string_agg(w, ' ' ORDER BY pos) AS toks FROM kept GROUP BY row_id, model), fixed AS (
  SELECT row_id, model, {sql_detokenised("coalesce(toks, '')")} AS prediction FROM predictions LEFT JOIN repaired USING (row_id, model))"""
CLEAN_PREDICTIONS = f"WITH {v.PREDICTIONS}, {REPAIR} SELECT row_id, model, prediction FROM fixed"


def multi_model_table(spark, sf):
    rows = v.predictions(spark, sf).withColumn("prediction", text.treebank(F.col("prediction"))).withColumn("target", F.get("targets", F.lit(0)))
    models = {m: rows.filter(F.col("model") == m).drop("model") for m in v.MODELS}
    return predict.multi_model_table(models)


MULTI_MODEL = f"""WITH {v.PREDICTIONS}, {REPAIR}
SELECT p.row_id, p.source AS original, a.prediction AS m1, b.prediction AS m2, p.targets[1] AS target
FROM predictions p JOIN fixed a ON a.row_id = p.row_id AND a.model = 'm1' JOIN fixed b ON b.row_id = p.row_id AND b.model = 'm2' WHERE p.model = 'm1'"""


QUERIES = {
    "prepare_inputs": (prepare_inputs, PREPARE),
    "predict_table": (predict_table, PREDICT),
    "attach_quality_label": (attach_quality_label, QUALITY),
    "clean_predictions": (clean_predictions, CLEAN_PREDICTIONS),
    "multi_model_table": (multi_model_table, MULTI_MODEL),
}
