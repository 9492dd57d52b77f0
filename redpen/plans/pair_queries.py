"""Queries on cleaning, tokenising, statistics, ratings and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpen.functions import text
from redpen.operators import pairs, ratings, sampling, stats
from redpen.plans import views as v


def clean_text(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    return pairs.clean_text(docs, ["text"])


def _sql_clean(expr: str) -> str:
    out = f"regexp_replace({expr}, '[\\t\\r\\n]', ' ', 'g')"
    for mark in ("_", "-", "~", "+", ".", ":"):
        out = f"regexp_replace({out}, '[{mark}][{mark}]+', '{mark}', 'g')"
    for rule in (r"-\s*$", r"^\s*-", r":\s*$", r"^\s*:", r"_\s*$", r"^\s*_", r"~\s*$", r"^\s*\."):
        out = f"regexp_replace({out}, '{rule}', '')"
    return f"regexp_replace({out}, '\\s+', ' ', 'g')"


CLEAN = f"SELECT doc_id, {_sql_clean('text')} AS text FROM documents"


def drop_empty_pairs(spark, sf):
    return pairs.drop_empty_pairs(v.edit_pairs(spark, sf).select("pair_id", "source", "target"))


DROP_EMPTY = f"""WITH {v.EDIT_PAIRS} SELECT pair_id, source, target FROM edit_pairs WHERE len(edits) > 0"""


def validate_pairs(spark, sf):
    kept = pairs.drop_empty_pairs(v.chat_pairs(spark, sf))
    return pairs.validate_pairs(kept).agg(F.count(F.lit(1)).alias("valid_pairs"))


VALIDATE = f"""WITH {v.CHAT_PAIRS} SELECT count(*) AS valid_pairs FROM chat_pairs
WHERE trim(source) <> '' AND trim(target) <> ''"""


def tokenize_table(spark, sf):
    done = pairs.tokenize_table(v.table(spark, sf, "conversations"), ["text"])
    return done.select("conv_id", "turn", "text_spaced", F.size("text_tokens").cast("bigint").alias("n_tokens"))


def sql_treebank(expr: str) -> str:
    out = f"concat(' ', regexp_replace({expr}, '\\s+', ' ', 'g'), ' ')"
    for pattern, to in text.TREEBANK_RULES:
        to = to.replace("$", "\\")
        out = "regexp_replace({}, '{}', '{}', 'g')".format(out, pattern.replace("'", "''"), to.replace("'", "''"))
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


TOKENIZE = f"""SELECT conv_id, turn, spaced AS text_spaced, len({v.sql_tokens('spaced')})::BIGINT AS n_tokens
FROM (SELECT conv_id, turn, {sql_treebank('text')} AS spaced FROM conversations)"""


def token_table(spark, sf):
    return pairs.token_table(v.table(spark, sf, "conversations"), "text", ["conv_id", "turn"]).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "token"
    )


TOKEN_TABLE = f"""SELECT conv_id, turn, unnest(range(0, len(toks))) AS pos, unnest(toks) AS token
FROM (SELECT conv_id, turn, {v.sql_tokens('text')} AS toks FROM conversations)"""


def mask_tokens(spark, sf):
    toks = v.lines(spark, sf).select("pair_id", F.col("toks").alias("pieces"))
    return pairs.mask_tokens(toks).select("pair_id", text.spaced(F.col("pieces")).alias("masked"))


_KEPT = ", ".join(f"'{p}'" for p in text.KEPT_PIECES + text.SPECIAL_PIECES)
MASK_TOKENS = f"""WITH {v.LINES} SELECT pair_id, array_to_string(list_transform(toks, lambda t:
  CASE WHEN t IN ({_KEPT}) THEN t WHEN regexp_full_match(t, '\\p{{Nd}}+|##[0-9]*') THEN '[NUMBER]'
       WHEN regexp_full_match(t, '\\p{{L}}+|##[A-Za-z]+') THEN t ELSE '[SYMBOL]' END), ' ') AS masked FROM lines"""


def _rounded(df, keep=()):
    return df.select(*[
        F.round(F.col(c), 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes
    ])


def pair_stats(spark, sf):
    kept = pairs.drop_empty_pairs(v.edit_pairs(spark, sf).select("source", "target"))
    return _rounded(stats.pair_stats(kept))


_STAT = "round(avg({0}), 6) AS {0}_mean, round(stddev_pop({0}), 6) AS {0}_std"
PAIR_STATS = f"""WITH {v.EDIT_PAIRS}, spaced AS (
  SELECT len(toks) AS source_words, len(edits) AS target_words,
         {v.sql_tokens('lower(' + sql_treebank('source') + ')')} AS s,
         {v.sql_tokens('lower(' + sql_treebank('target') + ')')} AS t
  FROM edit_pairs WHERE len(edits) > 0), measured AS (
  SELECT source_words, target_words, greatest(len(list_filter(s, lambda w: w IN ('.', '!', '?'))), 1) AS sentences,
         len(list_distinct(list_filter(t, lambda w: NOT list_contains(s, w)))) AS new_words,
         target_words / source_words AS ratio FROM spaced)
SELECT count(*) AS pairs, {_STAT.format('source_words')}, max(source_words)::BIGINT AS source_words_max,
  min(source_words)::BIGINT AS source_words_min, {_STAT.format('target_words')},
  max(target_words)::BIGINT AS target_words_max, min(target_words)::BIGINT AS target_words_min,
  {_STAT.format('sentences')}, {_STAT.format('new_words')}, {_STAT.format('ratio')} FROM measured"""


def label_balance(spark, sf):
    return _rounded(stats.label_balance(v.class_predictions(spark, sf), "target"))


LABEL_BALANCE = f"""WITH {v.CLASS_PREDICTIONS} SELECT count(*) AS samples,
  count(*) FILTER (target = 0) AS negatives, round(count(*) FILTER (target = 0) / count(*), 6) AS negative_rate
FROM class_predictions"""


def _ratings_out(df, *more):
    return df.select(
        "row_id", F.col("summary_no").cast("bigint").alias("summary_no"), "source", "target",
        F.array_join("ratings", ",").alias("ratings"), *more,
    )


def explode_rated_summaries(spark, sf):
    return _ratings_out(ratings.explode_rated_summaries(v.rated_lines(spark, sf)))


EXPLODE_RATED = f"""WITH {v.RATED} SELECT row_id, summary_no, source, target, array_to_string(ratings, ',') AS ratings
FROM rated"""


def filter_low_rated(spark, sf):
    rated = ratings.explode_rated_summaries(v.rated_lines(spark, sf))
    return _ratings_out(ratings.filter_low_rated(rated))


FILTER_LOW = f"""{EXPLODE_RATED} WHERE len(ratings) = 0 OR
  len(list_intersect(ratings, ['9', '14', '21', '22', '24'])) / len(ratings) < 0.5"""


def rating_labels(spark, sf):
    rated = ratings.explode_rated_summaries(v.rated_lines(spark, sf))
    return _ratings_out(ratings.rating_labels(rated), "grammar", "meaning")


def _sql_label(buckets) -> str:
    counts = [
        "len(list_filter(ratings, lambda r: r IN ({})))".format(", ".join(f"'{c}'" for c in codes)) for codes in buckets
    ]
    return f"({counts[2]} > {counts[0]} AND {counts[2]} > {counts[1]})::INT"


RATING_LABELS = f"""WITH {v.RATED} SELECT row_id, summary_no, source, target, array_to_string(ratings, ',') AS ratings,
  {_sql_label(ratings.GRAMMAR_BUCKETS)} AS grammar, {_sql_label(ratings.MEANING_BUCKETS)} AS meaning
FROM rated WHERE len(ratings) > 0"""


def split_dataset(spark, sf):
    done = sampling.split_dataset(v.edit_pairs(spark, sf), 200, 300, "pair_id", shuffle_all=True, seed=3)
    return done.select("pair_id", "source", "target", "split")


_SPLIT = """SELECT pair_id, source, target, CASE WHEN r <= 200 THEN 'tune' WHEN r <= 500 THEN 'valid' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {}) AS r FROM edit_pairs)"""
SPLIT = f"WITH {v.EDIT_PAIRS} " + _SPLIT.format("substr(md5(concat('3:', pair_id)), 1, 15), pair_id")


def split_in_order(spark, sf):
    done = sampling.split_dataset(v.edit_pairs(spark, sf), 200, 300, "pair_id", shuffle_parts=True)
    return done.select("pair_id", "source", "target", "split")


SPLIT_IN_ORDER = f"WITH {v.EDIT_PAIRS} " + _SPLIT.format("pair_id")


def sample_rows(spark, sf):
    return sampling.sample_rows(v.table(spark, sf, "documents"), 150, "doc_id", 9).select("doc_id", "lang", "n_chars")


SAMPLE = """SELECT doc_id, lang, n_chars FROM documents
ORDER BY substr(md5(concat('9:', doc_id)), 1, 15), doc_id LIMIT 150"""


def limit_examples(spark, sf):
    return sampling.limit_examples(v.edit_pairs(spark, sf), 1000, "pair_id").select("pair_id", "source")


LIMIT_EXAMPLES = f"WITH {v.EDIT_PAIRS} SELECT pair_id, source FROM edit_pairs ORDER BY pair_id LIMIT 1000"

GOAL = 0.18


def mix_to_ratio(spark, sf):
    rows = v.class_predictions(spark, sf)
    base = rows.select("doc_id", "text", F.col("target").alias("label"))
    extra = rows.select("doc_id", "text", (1 - F.col("toxic")).alias("label"))
    return sampling.mix_to_ratio(base, extra, GOAL, "doc_id").select("doc_id", "label", "origin")


MIX_TO_RATIO = f"""WITH {v.CLASS_PREDICTIONS}, n AS (
  SELECT count(*) FILTER (target = 0) + count(*) FILTER (toxic = 1) AS neg, count(*) FILTER (target = 1) AS pos
  FROM class_predictions)
SELECT doc_id, target AS label, 'base' AS origin FROM class_predictions
UNION ALL SELECT doc_id, 0, 'extra' FROM class_predictions WHERE toxic = 1
UNION ALL SELECT doc_id, 1, 'extra' FROM (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM class_predictions WHERE toxic = 0)
WHERE r <= (SELECT trunc((1 - {GOAL}::DOUBLE) / {GOAL}::DOUBLE * neg - pos) FROM n)"""


def mix_negatives(spark, sf):
    base = v.class_predictions(spark, sf).select("doc_id", "text", F.col("target").alias("label"))
    made = v.table(spark, sf, "documents").select("doc_id", "text")
    return sampling.mix_negatives(base, made, 0.5, "doc_id", ["text"], seed=4).select("doc_id", "label", "origin")


MIX_NEGATIVES = f"""WITH {v.CLASS_PREDICTIONS}, n AS (
  SELECT trunc((count(*) FILTER (target = 0) - count(*) * 0.5) / (0.5 - 1)) AS n FROM class_predictions)
SELECT doc_id, target AS label, 'base' AS origin FROM class_predictions
UNION ALL SELECT doc_id, 0, 'synthetic' FROM (
  SELECT doc_id, row_number() OVER (ORDER BY substr(md5(concat('4:', doc_id)), 1, 15), doc_id) AS r FROM documents)
WHERE r <= (SELECT n FROM n)"""


def pad_to_batch(spark, sf):
    return sampling.pad_to_batch(v.table(spark, sf, "labels"), 64)


PAD_TO_BATCH = """SELECT doc_id, quality, toxic, 1 AS is_real_example FROM labels
UNION ALL SELECT NULL, NULL, NULL, 0 FROM range((SELECT (64 - count(*) % 64) % 64 FROM labels))"""


QUERIES = {
    "clean_text": (clean_text, CLEAN),
    "drop_empty_pairs": (drop_empty_pairs, DROP_EMPTY),
    "validate_pairs": (validate_pairs, VALIDATE),
    "tokenize_table": (tokenize_table, TOKENIZE),
    "token_table": (token_table, TOKEN_TABLE),
    "mask_tokens": (mask_tokens, MASK_TOKENS),
    "pair_stats": (pair_stats, PAIR_STATS),
    "label_balance": (label_balance, LABEL_BALANCE),
    "explode_rated_summaries": (explode_rated_summaries, EXPLODE_RATED),
    "filter_low_rated": (filter_low_rated, FILTER_LOW),
    "rating_labels": (rating_labels, RATING_LABELS),
    "split_dataset": (split_dataset, SPLIT),
    "split_in_order": (split_in_order, SPLIT_IN_ORDER),
    "sample_rows": (sample_rows, SAMPLE),
    "limit_examples": (limit_examples, LIMIT_EXAMPLES),
    "mix_to_ratio": (mix_to_ratio, MIX_TO_RATIO),
    "mix_negatives": (mix_negatives, MIX_NEGATIVES),
    "pad_to_batch": (pad_to_batch, PAD_TO_BATCH),
}
