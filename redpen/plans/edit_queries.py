"""Queries on phrase vocabularies, edit tags and realised texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from redpen.functions import text
from redpen.functions.kernels import dealt_udf, halves_udf
from redpen.operators import tagging, vocabulary
from redpen.plans import views as v
from redpen.plans.pair_queries import _rounded
from redpen.session import stage

SIZE, EXTRA = 6, 4


# phrases as the generator made them: maximal runs of inserted words
def insert_runs(spark, sf):
    edits = v.edit_pairs(spark, sf).select("pair_id", "edits")
    joined = F.array_join(F.transform("edits", lambda x: F.when(x["new"], x["t"]).otherwise("|")), " ")
    runs = F.filter(F.transform(F.split(joined, r"\|"), lambda p: F.trim(p)), lambda p: p != "")
    return edits.select("pair_id", runs.alias("phrases"))


RUNS = f"""{v.EDIT_PAIRS}, runs AS (
  SELECT pair_id, list_filter(list_transform(string_split(array_to_string(list_transform(edits,
    lambda x: CASE WHEN x.new THEN x.t ELSE '|' END), ' '), '|'), lambda p: trim(p)), lambda p: p <> '') AS phrases
  FROM edit_pairs), rows AS (
  SELECT pair_id, unnest(range(0, len(phrases))) AS pos, unnest(phrases) AS phrase FROM runs), counts AS (
  SELECT phrase, count(*) AS freq, min(pair_id * 100000 + pos) AS seen FROM rows GROUP BY phrase), ranked AS (
  SELECT phrase, freq, row_number() OVER (ORDER BY freq DESC, seen) AS rank FROM counts)"""


def phrase_counts(spark, sf):
    counts = vocabulary.phrase_counts(insert_runs(spark, sf))
    return counts.select("phrase", "freq", F.col("first.example_id").alias("example_id"), F.col("first.pos").cast("bigint").alias("pos"))


PHRASE_COUNTS = f"""WITH {RUNS} SELECT phrase, freq, seen // 100000 AS example_id, seen % 100000 AS pos FROM counts"""


def _vocabulary(spark, sf):
    return vocabulary.phrase_vocabulary(vocabulary.phrase_counts(insert_runs(spark, sf)), SIZE + EXTRA)


def phrase_vocabulary(spark, sf):
    return _vocabulary(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


PHRASE_VOCABULARY = f"WITH {RUNS} SELECT phrase, freq, rank FROM ranked WHERE rank <= {SIZE + EXTRA}"


def coverage_curve(spark, sf):
    curve = vocabulary.coverage_curve(insert_runs(spark, sf), _vocabulary(spark, sf))
    return _rounded(curve.withColumn("k", F.col("k").cast("bigint")))


COVERAGE = f"""WITH {RUNS}, worst AS (
  SELECT pair_id, max(rank) AS worst FROM rows JOIN ranked USING (phrase) GROUP BY pair_id)
SELECT rank AS k, freq, round(100.0 * ((SELECT count(*) FROM runs WHERE len(phrases) = 0)
  + (SELECT count(*) FROM worst WHERE worst <= rank)) / (SELECT count(*) FROM runs), 6) AS coverage, phrase
FROM ranked WHERE rank <= {SIZE + EXTRA}"""


def _label_map(spark, sf):
    """Written once, as it is measured, sent and looked up."""
    return stage(vocabulary.label_map_table(_vocabulary(spark, sf), SIZE, swap=True), "label-map")


def label_map_table(spark, sf):
    return _label_map(spark, sf)


LABEL_MAP = f"""WITH {RUNS} SELECT * FROM (VALUES ('KEEP', 0), ('DELETE', 1), ('SWAP', 2)) AS f(tag, tag_id)
UNION ALL SELECT 'KEEP|' || phrase, (3 + 2 * (rank - 1))::INT FROM ranked WHERE rank <= {SIZE}
UNION ALL SELECT 'DELETE|' || phrase, (4 + 2 * (rank - 1))::INT FROM ranked WHERE rank <= {SIZE}"""


def label_map_phrases(spark, sf):
    return vocabulary.label_map_phrases(_label_map(spark, sf)).select(
        "phrase", F.col("length").cast("bigint").alias("length")
    )


LABEL_MAP_PHRASES = f"""WITH {RUNS} SELECT phrase, len(string_split(phrase, ' ')) AS length FROM ranked WHERE rank <= {SIZE}"""


def label_map_summary(spark, sf):
    return vocabulary.label_map_summary(_label_map(spark, sf))


LABEL_MAP_SUMMARY = f"""WITH {RUNS}, w AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS w FROM ranked WHERE rank <= {SIZE})
SELECT count(DISTINCT phrase) AS phrases, (SELECT max(len(string_split(phrase, ' '))) FROM ranked WHERE rank <= {SIZE})::BIGINT AS longest,
  count(DISTINCT w) AS tokens FROM w"""


def _sources(spark, sf):
    return v.edit_pairs(spark, sf).select("pair_id", F.array("source").alias("sources"), "target")


def added_phrases(spark, sf):
    """What the alignment finds, against whole source texts.

    No SQL twin: a line may have thousands of tokens, and the quadratic table of lengths as SQL lists did not
    end within minutes on the smallest tables. tests/test_edits.py tries all subsequences instead.
    """
    return vocabulary.phrase_rows(vocabulary.added_phrases(_sources(spark, sf)))


def added_phrases_swap(spark, sf):
    return vocabulary.phrase_rows(vocabulary.added_phrases(v.fusion(spark, sf), try_swap=True))


def mined_vocabulary(spark, sf):
    """Coverage of the mined phrases; the aligned phrases are staged as two aggregations read them."""
    mined = stage(vocabulary.added_phrases(_sources(spark, sf)), "phrases")
    ranked = vocabulary.phrase_vocabulary(vocabulary.phrase_counts(mined), 500)
    return vocabulary.coverage_curve(mined, ranked)


def tag_pairs(spark, sf):
    tagged = tagging.tag_pairs(_sources(spark, sf), _label_map(spark, sf))
    return tagged.select("pair_id", F.array_join("tags", " ").alias("tags"), "feasible", "swapped")


# the greedy walk as a fold over the source tokens: j of the target reached, the first of the
# deletions just before; n is the number of words added before the token, negative if it goes
_WALK = f"""ph AS (SELECT list(phrase) AS ph, max(len(string_split(phrase, ' '))) AS longest FROM ranked WHERE rank <= {SIZE}), walked AS (
  SELECT id, tgt, list_reduce(
    list_transform(src, lambda t: {{'j': 0::BIGINT, 'gap': 0::BIGINT, 'i': 0::BIGINT, 'tok': t, 'edits': [{{'kind': '', 'phrase': '', 'slot': 0::BIGINT}}]}}),
    lambda acc, x: list_transform([CASE WHEN acc.j >= len(tgt) THEN -1 WHEN tgt[acc.j + 1] = x.tok THEN 0
        ELSE coalesce(list_filter(range(1, longest + 1), lambda n: tgt[acc.j + n + 1] = x.tok
          AND list_contains(ph, array_to_string(tgt[acc.j + 1:acc.j + n], ' ')))[1], -1) END],
      lambda n: {{'j': CASE WHEN n >= 0 THEN acc.j + n + 1 ELSE acc.j END, 'gap': CASE WHEN n >= 0 THEN acc.i + 1 ELSE acc.gap END,
        'i': acc.i + 1, 'tok': '', 'edits': list_append(acc.edits, {{'kind': CASE WHEN n >= 0 THEN 'KEEP' ELSE 'DELETE' END,
          'phrase': CASE WHEN n > 0 THEN array_to_string(tgt[acc.j + 1:acc.j + n], ' ') ELSE '' END, 'slot': acc.gap}})}})[1],
    {{'j': 0::BIGINT, 'gap': 0::BIGINT, 'i': 0::BIGINT, 'tok': '', 'edits': [{{'kind': '', 'phrase': '', 'slot': 0::BIGINT}}]}}) AS done
  FROM tasks, ph WHERE len(src) > 0), tagged AS (
  SELECT id, list_transform(edits, lambda e, p: e.kind || CASE WHEN list_contains(slots, p - 1)
      THEN '|' || list_filter(edits, lambda q: q.slot = p - 1 AND q.phrase <> '')[1].phrase ELSE '' END) AS tags
  FROM (SELECT id, done.edits[2:] AS edits, list_transform(list_filter(done.edits, lambda e: e.phrase <> ''), lambda e: e.slot) AS slots
        FROM walked WHERE done.j = len(tgt)))"""
TAG_PAIRS = f"""WITH {RUNS}, tasks AS (
  SELECT pair_id AS id, list_transform(toks, lambda t: lower(t)) AS src, list_transform(edits, lambda x: lower(x.t)) AS tgt
  FROM edit_pairs), {_WALK}
SELECT pair_id, coalesce(array_to_string(tags, ' '), '') AS tags, tags IS NOT NULL AS feasible, false AS swapped
FROM edit_pairs LEFT JOIN tagged ON id = pair_id"""


def tag_fusion(spark, sf):
    tagged = tagging.tag_pairs(v.fusion(spark, sf), _label_map(spark, sf))
    return tagged.select("pair_id", F.array_join("tags", " ").alias("tags"), "feasible", "swapped")


_ORDERED = "CASE WHEN substr(md5(concat('5:', pair_id)), 1, 1) < '8' THEN list_concat(two, one) ELSE list_concat(one, two) END"
TAG_FUSION = f"""WITH {RUNS}, {v.FUSION.split(f'{v.LINES}, ')[1]}, aimed AS (
  SELECT pair_id, one, two, list_transform({v.sql_edited(v.sql_hashed(_ORDERED, 'pair_id'), v.TARGET)}, lambda x: lower(x.t)) AS tgt FROM fusion), tasks AS (
  SELECT pair_id * 2 AS id, list_transform(list_concat(one, two), lambda t: lower(t)) AS src, tgt FROM aimed
  UNION ALL SELECT pair_id * 2 + 1, list_transform(list_concat(two, one), lambda t: lower(t)), tgt FROM aimed WHERE len(two) > 0), {_WALK}, turned AS (
  SELECT pair_id, len(one) AS last, list_concat(tags[len(two) + 1:], tags[:len(two)]) AS tags FROM aimed JOIN tagged ON id = pair_id * 2 + 1), swaps AS (
  SELECT pair_id, list_concat(tags[:last - 1], ['SWAP' || substr(tags[last], strpos(tags[last] || '|', '|'))], tags[last + 1:]) AS tags FROM turned)
SELECT f.pair_id, coalesce(array_to_string(coalesce(t.tags, s.tags), ' '), '') AS tags, coalesce(t.tags, s.tags) IS NOT NULL AS feasible,
  t.tags IS NULL AND s.tags IS NOT NULL AS swapped
FROM fusion f LEFT JOIN tagged t ON t.id = f.pair_id * 2 LEFT JOIN swaps s ON s.pair_id = f.pair_id"""


def tag_round_trip(spark, sf):
    """Realised texts of all feasible rows, case aside: they have to be the targets."""
    tagged = tagging.apply_infeasible_policy(tagging.tag_pairs(_sources(spark, sf), _label_map(spark, sf)), "train")
    return tagging.realize(tagged).select("pair_id", F.lower("realized").alias("text"))


TAG_ROUND_TRIP = f"""WITH {RUNS}, tasks AS (
  SELECT pair_id AS id, list_transform(toks, lambda t: lower(t)) AS src, list_transform(edits, lambda x: lower(x.t)) AS tgt
  FROM edit_pairs), {_WALK}
SELECT pair_id, lower(target) AS text FROM edit_pairs JOIN tagged ON id = pair_id"""


# tags by hash: 3/16 deleted, 1/16 kept with a word before, 1/16 deleted with a word before
_DEALT = ["DELETE"] * 3 + ["KEEP|and", "DELETE|or so"] + ["KEEP"] * 11


def generated_tags(spark, sf):
    """The sources of ``fusion`` with ``tokens`` and ``tags``."""
    made = v.lines(spark, sf).withColumns({"sources": halves_udf()("text"), "_d": dealt_udf(21, _DEALT, 22)("text", "pair_id")})
    return made.select("pair_id", "sources", "_d.tokens", "_d.tags")


_TAG = """CASE WHEN d < '3' THEN 'DELETE' WHEN d = '3' THEN 'KEEP|and' WHEN d = '4' THEN 'DELETE|or so' ELSE 'KEEP' END"""
GENERATED = f"""{v.FUSION}, tokens AS (
  SELECT pair_id, len(one) AS n_one, len(two) AS n_two, unnest(list_concat(one, two)) AS token,
         unnest(range(0, len(one) + len(two))) AS i FROM fusion), generated AS (
  SELECT pair_id, i, token, n_one, n_two, CASE WHEN n_two > 0 AND i = n_one - 1
      AND substr(md5(concat('22:', pair_id)), 1, 1) < '8' THEN 'SWAP' ELSE {_TAG} END AS tag
  FROM (SELECT *, substr(md5(concat('21:', pair_id, ':', i)), 1, 1) AS d FROM tokens))"""


def realize(spark, sf):
    done = tagging.realize(generated_tags(spark, sf))
    return done.select("pair_id", "realized")


REALIZE = f"""WITH {GENERATED}, words AS (
  SELECT pair_id, i, i >= n_one AS late, n_two > 0 AS two, bool_or(tag = 'SWAP') OVER (PARTITION BY pair_id) AS swap,
    CASE WHEN tag = 'DELETE' THEN NULL WHEN tag = 'KEEP|and' THEN 'and ' || token WHEN tag = 'DELETE|or so' THEN 'or so' ELSE token END AS w
  FROM generated), halves AS (
  SELECT pair_id, any_value(two) AS two, any_value(swap) AS swap, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (NOT late), '') AS a,
    coalesce(string_agg(w, ' ' ORDER BY i) FILTER (late), '') AS b FROM words GROUP BY pair_id), ordered AS (
  SELECT pair_id, two, a, CASE WHEN swap THEN b ELSE a END AS lead, CASE WHEN swap THEN a ELSE b END AS tail FROM halves)
SELECT pair_id, CASE WHEN NOT two THEN a WHEN lead = '' OR right(lead, 1) IN ('.', '!', '?')
  THEN lead || ' ' || upper(tail[1]) || tail[2:] ELSE lead || ' ' || lower(tail[1]) || tail[2:] END AS realized FROM ordered"""


def _policy_rows(spark, sf):
    pairs = v.edit_pairs(spark, sf).select("pair_id", F.col("toks").alias("tokens"), F.size("edits").alias("n"))
    tags = F.when(F.col("n") == F.size("tokens"), F.transform("tokens", lambda t: F.lit("KEEP")))
    return pairs.withColumn("tags", F.coalesce(tags, F.expr("cast(array() as array<string>)"))).withColumn(
        "feasible", F.size("tags") > 0
    )


def infeasible_tune(spark, sf):
    done = tagging.apply_infeasible_policy(_policy_rows(spark, sf), "tune")
    return done.select("pair_id", F.array_join("tags", " ").alias("tags"))


INFEASIBLE_TUNE = f"""WITH {v.EDIT_PAIRS} SELECT pair_id, array_to_string(list_transform(toks,
  lambda t, i: CASE WHEN len(edits) = len(toks) OR i % 2 = 1 THEN 'KEEP' ELSE 'DELETE' END), ' ') AS tags FROM edit_pairs"""


def infeasible_train(spark, sf):
    done = tagging.apply_infeasible_policy(_policy_rows(spark, sf), "train")
    return done.select("pair_id", F.array_join("tags", " ").alias("tags"))


INFEASIBLE_TRAIN = f"""WITH {v.EDIT_PAIRS} SELECT pair_id, array_to_string(list_transform(toks, lambda t: 'KEEP'), ' ') AS tags
FROM edit_pairs WHERE len(edits) = len(toks)"""


def conversion_report(spark, sf):
    return _rounded(tagging.conversion_report(_policy_rows(spark, sf)))


CONVERSION = f"""WITH {v.EDIT_PAIRS} SELECT count(*) AS seen, count(*) FILTER (len(edits) = len(toks)) AS converted,
  round(count(*) FILTER (len(edits) = len(toks)) / count(*), 6) AS rate FROM edit_pairs"""


def tag_report(spark, sf):
    return tagging.tag_report(generated_tags(spark, sf).withColumn("feasible", F.lit(True)))


TAG_REPORT = f"""WITH {GENERATED} SELECT tag, split_part(tag, '|', 1) AS kind, count(*) AS uses FROM generated GROUP BY tag"""

_TAG_IDS = {"KEEP": 0, "DELETE": 1, "SWAP": 2, "KEEP|and": 3, "DELETE|or so": 4}


def token_loss_weights(spark, sf):
    label_map = spark.createDataFrame(list(_TAG_IDS.items()), "tag string, tag_id int")
    ids = F.create_map(*[F.lit(x) for item in _TAG_IDS.items() for x in item])
    rows = generated_tags(spark, sf).select(
        "pair_id",
        F.transform("tags", lambda t: F.element_at(ids, t)).alias("labels"),
        F.transform("tokens", lambda t: F.least(F.length(t), F.lit(40))).alias("segment_ids"),
    )
    weighted = tagging.token_loss_weights(rows, label_map, add=1.5, keep=0.5, delete=2.0, verb=3.0, tagset="concise")
    total = F.aggregate("weights", F.lit(0.0), lambda acc, w: acc + w)
    return _rounded(weighted.select("pair_id", total.alias("weight")))


LOSS_WEIGHTS = f"""WITH {GENERATED} SELECT pair_id, round(sum(
  CASE WHEN tag LIKE '%|%' THEN 1.5 ELSE 1 END * CASE WHEN tag LIKE 'KEEP%' THEN 0.5 ELSE 1 END
  * CASE WHEN tag LIKE 'DELETE%' THEN 2.0 ELSE 1 END
  * CASE WHEN tag LIKE 'DELETE%' AND length(token) = 3 THEN 4.0 ELSE 1 END)::DOUBLE, 6) AS weight
FROM generated GROUP BY pair_id"""


QUERIES = {
    "phrase_counts": (phrase_counts, PHRASE_COUNTS),
    "phrase_vocabulary": (phrase_vocabulary, PHRASE_VOCABULARY),
    "coverage_curve": (coverage_curve, COVERAGE),
    "label_map_table": (label_map_table, LABEL_MAP),
    "label_map_phrases": (label_map_phrases, LABEL_MAP_PHRASES),
    "label_map_summary": (label_map_summary, LABEL_MAP_SUMMARY),
    "added_phrases": (added_phrases, None),
    "added_phrases_swap": (added_phrases_swap, None),
    "mined_vocabulary": (mined_vocabulary, None),
    "tag_pairs": (tag_pairs, TAG_PAIRS),
    "tag_fusion": (tag_fusion, TAG_FUSION),
    "tag_round_trip": (tag_round_trip, TAG_ROUND_TRIP),
    "realize": (realize, REALIZE),
    "infeasible_tune": (infeasible_tune, INFEASIBLE_TUNE),
    "infeasible_train": (infeasible_train, INFEASIBLE_TRAIN),
    "conversion_report": (conversion_report, CONVERSION),
    "tag_report": (tag_report, TAG_REPORT),
    "token_loss_weights": (token_loss_weights, LOSS_WEIGHTS),
}
