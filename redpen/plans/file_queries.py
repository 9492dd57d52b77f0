"""Readers and writers at work: tables go out through a writer and come back through a reader.

Files lie in the shared folder, one fresh path per run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from redpen.functions.hashing import below
from redpen.operators import clusters, pairs, ratings, sampling, scoring, spans
from redpen.plans import edit_queries as e, feature_queries as f, pair_queries as p, score_queries as s, span_queries as q, views as v
from redpen.plans.pair_queries import _rounded
from redpen.session import stage, staged_path
from redpen.sources import readers, writers

RAW = {"sep": "\t", "quote": "", "escape": "", "emptyValue": ""}


def read_pairs(spark, sf):
    path = staged_path(spark, "pairs")
    v.edit_pairs(spark, sf).select("source", "target").write.csv(path, **RAW)
    return readers.read_pairs(spark, path).select(F.col("sources")[0].alias("source"), "target")


PAIRS = f"WITH {v.EDIT_PAIRS} SELECT source, target FROM edit_pairs"


def write_pairs(spark, sf):
    path = staged_path(spark, "quoted-pairs")
    writers.write_pairs(v.edit_pairs(spark, sf), path)
    return readers.read_quoted_pairs(spark, path).select("source", "target")


def write_splits(spark, sf):
    path = staged_path(spark, "splits")
    done = sampling.split_dataset(v.edit_pairs(spark, sf), 200, 300, "pair_id", shuffle_all=True, seed=3)
    writers.write_splits(done, path, cols=("pair_id", "source", "target"))
    return spark.read.schema("pair_id bigint, source string, target string, split string").parquet(path)


def read_fusion(spark, sf):
    path = staged_path(spark, "fusion")
    rows = v.fusion(spark, sf)
    part = lambda i: F.coalesce(F.get("sources", F.lit(i)), F.lit(""))
    cells = [F.lit(""), F.col("target"), part(0), part(1), *[F.lit("x")] * 4]
    names = readers.FUSION_COLUMNS.split()
    rows.select(*[c.alias(n) for c, n in zip(cells, names)]).write.csv(path, header=True, **RAW)
    back = readers.read_fusion(spark, path)
    return back.select(F.col("sources")[0].alias("one"), F.col("sources")[1].alias("two"))


FUSION = f"WITH {v.FUSION} SELECT array_to_string(one, ' ') AS one, array_to_string(two, ' ') AS two FROM fusion"


def read_rated_rows(spark, sf):
    path = staged_path(spark, "rated")
    v.rated_lines(spark, sf).select("line").write.text(path)
    rated = ratings.explode_rated_summaries(readers.read_rated_rows(spark, [path]))
    return rated.select(
        F.col("summary_no").cast("bigint").alias("summary_no"), "source", "target", F.array_join("ratings", ",").alias("ratings")
    )


RATED = f"WITH {v.RATED} SELECT summary_no, source, target, array_to_string(ratings, ',') AS ratings FROM rated"


def read_compression_json(spark, sf):
    path = staged_path(spark, "compression")
    record = F.struct(F.struct(F.col("source").alias("sentence")).alias("graph"), F.col("target").alias("headline"), F.col("target").alias("sentence"))
    printed = v.edit_pairs(spark, sf).select(F.concat(F.to_json(record, {"pretty": "true"}), F.lit("\n")))
    printed.write.text(path)
    return readers.read_compression_json(spark, path).select("source", "target")


def read_predictions(spark, sf):
    path = staged_path(spark, "predictions")
    line = F.concat_ws("\t", "source", "prediction", F.array_join("targets", "\t"))
    v.predictions(spark, sf).select(line).write.text(path)
    back = readers.read_predictions(spark, path, lowercase=True)
    return back.select("source", "prediction", F.array_join("targets", "|").alias("targets"))


PREDICTIONS = f"""WITH {v.PREDICTIONS} SELECT lower(source) AS source, lower(prediction) AS prediction,
  lower(array_to_string(targets, '|')) AS targets FROM predictions"""


def read_sentence_documents(spark, sf):
    path = staged_path(spark, "documents")
    q.sentence_docs(spark, sf).select(
        F.concat(F.array_join(F.transform("sentences", lambda x: F.array_join(x, " ")), "\n"), F.lit("\n"))
    ).write.text(path)
    return readers.read_sentence_documents(spark, path).select(F.array_join("sentences", "|").alias("sentences"))


DOCUMENTS = f"""WITH {q.SENTENCES} SELECT array_to_string(list_transform(sentences, lambda s: array_to_string(s, ' ')), '|') AS sentences FROM docs"""


def read_bar_pairs(spark, sf):
    path = staged_path(spark, "bars")
    v.fusion(spark, sf).select(F.array_join("sources", " ||| ")).write.text(path)
    return readers.read_bar_pairs(spark, path).select("text_a", "text_b")


BARS = f"""WITH {v.FUSION} SELECT array_to_string(one, ' ') AS text_a, CASE WHEN len(two) > 0 THEN array_to_string(two, ' ') END AS text_b FROM fusion"""


def read_keyword_table(spark, sf):
    path = staged_path(spark, "keywords")
    table = v.keywords(spark, sf)
    table.select("keyword", "m1", "m2").write.csv(path, header=True, **writers.QUOTED)
    back, models = readers.read_keyword_table(spark, path)
    long = clusters.unpivot_models(back, models)
    return clusters.cluster_sizes(long).filter(F.col("size") > 1)


KEYWORDS = f"""WITH {v.KEYWORDS} SELECT model, short, count(*) AS size FROM keywords WHERE short <> '' GROUP BY ALL HAVING count(*) > 1"""


def write_clusters(spark, sf):
    path = staged_path(spark, "clusters")
    writers.write_clusters(s.keyword_clusters(spark, sf), path)
    return spark.read.parquet(path)


def read_class_rows(spark, sf):
    path = staged_path(spark, "class-rows")
    pair = pairs.clean_text(v.class_predictions(spark, sf), ["text"])
    pair.select(F.concat_ws("\t", "text", F.col("target").cast("string"))).write.text(path)
    return readers.read_class_rows(spark, path, "grammar").select("text", "label")


CLASS_ROWS = f"WITH {v.CLASS_PREDICTIONS} SELECT {p._sql_clean('text')} AS text, target AS label FROM class_predictions"


def read_class_predictions(spark, sf):
    path = staged_path(spark, "class-predictions")
    v.class_predictions(spark, sf).select(F.concat_ws("\t", "doc_id", "prediction", "target")).write.text(path)
    return _rounded(scoring.class_report(readers.read_class_predictions(spark, path)))


def write_label_map(spark, sf):
    path = staged_path(spark, "label-map")
    writers.write_label_map(e.label_map_table(spark, sf), path)
    return readers.read_label_map(spark, path)


def write_class_mix(spark, sf):
    """Both tables with all their rows, as they come back."""
    path = staged_path(spark, "class-mix")
    labelled = ratings.rating_labels(ratings.explode_rated_summaries(v.rated_lines(spark, sf)))
    # written once: the split counts the keys in several passes and the writer reads all rows twice
    keyed = stage(labelled.withColumn("key", F.col("row_id") * 8 + F.col("summary_no")), "labelled")
    done = sampling.split_dataset(keyed, 100, 200, "key", shuffle_all=True, seed=6)
    writers.write_class_mix(done, path)
    options = {"sep": "\t", "quote": '"', "escape": '"', "nullValue": "\x00", "emptyValue": ""}
    meaning = spark.read.csv(f"{path}/meaning", schema="source string, target string, label int, split string", **options)
    grammar = spark.read.csv(f"{path}/grammar", schema="target string, label int, split string", **options)
    both = meaning.withColumn("kind", F.lit("meaning")).unionByName(grammar.withColumns({"kind": F.lit("grammar"), "source": F.lit("")}))
    return both.select("kind", "split", "label", "source", "target")


CLASS_MIX = f"""WITH {v.RATED}, labelled AS (
  SELECT source, target, {p._sql_label(ratings.MEANING_BUCKETS)} AS meaning, {p._sql_label(ratings.GRAMMAR_BUCKETS)} AS grammar, row_number() OVER (
    ORDER BY substr(md5(concat('6:', row_id * 8 + summary_no)), 1, 15), row_id * 8 + summary_no) AS r
  FROM rated WHERE len(ratings) > 0), placed AS (
  SELECT *, CASE WHEN r <= 100 THEN 'tune' WHEN r <= 300 THEN 'valid' ELSE 'train' END AS split FROM labelled)
SELECT 'meaning' AS kind, split, meaning AS label, source, target FROM placed
UNION ALL SELECT 'grammar', split, grammar, '', target FROM placed"""


def write_features(spark, sf):
    """Feature rows as they come back, and the number of rows the writer saw."""
    path = staged_path(spark, "features")
    seen = writers.write_features(f.edit_features(spark, sf), path)
    return spark.read.parquet(path).withColumn("observed", F.lit(seen).cast("bigint"))


FEATURES = f"SELECT *, count(*) OVER () AS observed FROM ({f.EDIT_FEATURES})"


def write_prediction_table(spark, sf):
    path = staged_path(spark, "wide")
    rows = v.predictions(spark, sf)
    wide = rows.groupBy("row_id").pivot("model", list(v.MODELS)).agg(F.first("prediction"))
    texts = v.edit_pairs(spark, sf).select(F.col("pair_id").alias("row_id"), F.col("source").alias("original"), "target")
    writers.write_prediction_table(texts.join(wide, "row_id").select("row_id", "original", *v.MODELS, "target"), path)
    back = spark.read.csv(path, header=True, sep="\t", quote='"', escape='"', nullValue="\x00", emptyValue="")
    return back.select("original", *[F.coalesce(c, F.lit("")).alias(c) for c in (*v.MODELS, "target")])


WIDE = f"""WITH {v.PREDICTIONS} SELECT a.source AS original, a.prediction AS m1, b.prediction AS m2, a.targets[1] AS target
FROM predictions a JOIN predictions b USING (row_id) WHERE a.model = 'm1' AND b.model = 'm2'"""


def score_table(spark, sf):
    """The five scores as rows, one column per model."""
    return writers.score_table(s.score_report(spark, sf), list(v.MODELS)).select("score", *v.MODELS)


SCORE_TABLE = f"""WITH report AS ({s.SCORE_REPORT}), long AS (
  SELECT model, unnest(['Exact score', 'SARI score', 'KEEP score', 'ADDITION score', 'DELETION score']) AS score,
    unnest([exact, sari, keep, addition, deletion]) AS value FROM report)
SELECT score, max(value) FILTER (model = 'm1') AS m1, max(value) FILTER (model = 'm2') AS m2 FROM long GROUP BY score"""


def write_score_table(spark, sf):
    """The written file of scores, read back with its header."""
    path = staged_path(spark, "scores")
    writers.write_score_table(s.score_report(spark, sf), list(v.MODELS), path)
    return _rounded(spark.read.csv(path, header=True, sep="\t", schema="score string, m1 double, m2 double"))


def write_qa_predictions(spark, sf):
    """All three files: every entry of the n-best lists next to the answer and the null odds."""
    path = staged_path(spark, "qa")
    nbest, nulls = q.nbest_and_nulls(spark, sf)
    writers.write_qa_predictions(nbest, spans.choose_answer(nbest, nulls, -0.2), path)
    odds = spark.read.json(f"{path}/null_odds", schema="question_id bigint, score_diff double")
    answers = spark.read.json(f"{path}/predictions", schema="question_id bigint, answer string")
    entry = "struct<text:string, probability:double, start_logit:double, end_logit:double>"
    lists = spark.read.json(f"{path}/nbest", schema=f"question_id bigint, nbest array<{entry}>")
    entries = lists.select("question_id", F.posexplode("nbest").alias("at", "e"))
    entries = entries.select("question_id", (F.col("at") + 1).cast("bigint").alias("rank"), "e.*")
    return _rounded(entries.join(answers, "question_id").join(odds, "question_id"))


QA_PREDICTIONS = f"""SELECT question_id, rank, text, probability, start_logit, end_logit, answer, score_diff
FROM ({q.NBEST_ANSWERS}) JOIN ({q.CHOOSE}) USING (question_id)"""


def write_probabilities(spark, sf):
    path = staged_path(spark, "probabilities")
    rows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.array(*[F.col("label").cast("double") / 16, 1 - F.col("label").cast("double") / 16]).alias("probabilities")
    )
    writers.write_probabilities(sampling.pad_to_batch(rows, 64), path)
    back = spark.read.csv(path, schema="p double, q double", sep="\t")
    return _rounded(back)


PROBABILITIES = "SELECT round(label / 16.0::DOUBLE, 6) AS p, round(1 - label / 16.0::DOUBLE, 6) AS q FROM embeddings"


QA_FILE_BYTES = 16 << 20  # text of a nested file, about


def read_qa_json(spark, sf):
    """Documents as paragraphs with one question each: answers from any place, one question in eight unanswerable.

    Every written file is one nested object, as the format has it. Their number grows with the texts, so that none does.
    """
    path = staged_path(spark, "qa-json")
    docs = v.documents(spark, sf).filter(F.length("text") > 0)
    at = below(F.length("text"), 65, F.col("doc_id")).cast("int")
    answer = F.struct(F.substr("text", at + 1, v._count(20, 66, F.col("doc_id")) + 1).alias("text"), at.alias("answer_start"))
    impossible = v.digit(67, 1, F.col("doc_id")) < "2"
    qa = F.struct(
        F.concat(F.lit("q-"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("What is said at "), at.cast("string"), F.lit("?")).alias("question"),
        impossible.alias("is_impossible"), F.when(impossible, F.expr("cast(array() as array<struct<text:string, answer_start:int>>)")).otherwise(F.array(answer)).alias("answers"),
    )
    paragraph = F.struct(F.col("text").alias("context"), F.array(qa).alias("qas"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    files = max(16, -(-total // QA_FILE_BYTES))
    blocks = docs.select(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(files)).alias("block"), paragraph.alias("p")).groupBy("block").agg(F.collect_list("p").alias("paragraphs"))
    entry = F.struct(F.array(F.struct(F.lit("t").alias("title"), F.col("paragraphs"))).alias("data"))
    blocks.select("block", F.to_json(entry).alias("value")).repartition(min(files, 2_000), "block").write.partitionBy("block").text(path)
    return readers.read_qa_json(spark, path, training=True, with_negative=True).select(
        "question_id", "question", "context", "is_impossible", "answer_text", F.col("answer_start").cast("bigint").alias("answer_start")
    )


QA_JSON = f"""WITH picked AS (
  SELECT doc_id, text, floor({v.sql_uniform(65, 'doc_id')} * length(text))::BIGINT AS o, {v.sql_count(20, 66, 'doc_id')} + 1 AS k,
    {v.sql_digit(67, 1, 'doc_id')} < '2' AS none FROM documents WHERE length(text) > 0)
SELECT concat('q-', doc_id) AS question_id, concat('What is said at ', o, '?') AS question, text AS context, none AS is_impossible,
  CASE WHEN none THEN '' ELSE substr(text, o + 1, k) END AS answer_text, CASE WHEN NOT none THEN o END AS answer_start FROM picked"""


def read_headline_csvs(spark, sf):
    wide, short = staged_path(spark, "wide-csv"), staged_path(spark, "short-csv")
    quoted = {"header": True, "quote": '"', "escape": '"', "encoding": "ISO-8859-1", "quoteAll": True, "emptyValue": ""}
    latin = lambda c: F.regexp_replace(c, r"[^\x00-\xff]", "?")
    chat = v.chat_pairs(spark, sf).select(latin("source").alias("text"), latin("target").alias("headlines"))
    chat.select(F.lit("a").alias("author"), "headlines", "text").write.csv(wide, **quoted)
    chat.select("headlines", "text").write.csv(short, **quoted)
    return readers.read_headline_csvs(spark, wide, short).select("source", "target")


_LATIN = "regexp_replace({}, '[^\\x00-\\x{{ff}}]', '?', 'g')"
HEADLINES = f"""WITH {v.CHAT_PAIRS}, latin AS (SELECT {_LATIN.format('source')} AS source, {_LATIN.format('target')} AS target FROM chat_pairs)
SELECT source, target FROM latin UNION ALL SELECT source, target FROM latin"""


def read_title_tldr(spark, sf):
    path = staged_path(spark, "tldr")
    v.chat_pairs(spark, sf).select(F.col("source").alias("tldr"), F.col("target").alias("title"), F.lit(1).alias("ups")).write.json(path)
    return readers.read_title_tldr(spark, path).select("source", "target")


def read_acceptability(spark, sf):
    path = staged_path(spark, "acceptability")
    rows = pairs.clean_text(v.class_predictions(spark, sf), ["text"])
    rows.select(F.lit("src"), F.col("target").cast("string"), F.lit("*"), "text").write.csv(path, **writers.QUOTED)
    return readers.read_acceptability(spark, path).select("text", "label")


def read_labelled_pairs(spark, sf):
    """The five-column layout with a header in every file."""
    path = staged_path(spark, "labelled")
    halves = v.fusion(spark, sf).filter(F.size("sources") == 2)
    label = F.when(v.digit(71, 1, F.col("pair_id")) < "8", "0").otherwise("1")
    halves.select(
        label.alias("quality"), F.lit("1").alias("id_1"), F.lit("2").alias("id_2"),
        F.col("sources")[0].alias("string_1"), F.col("sources")[1].alias("string_2"),
    ).write.csv(path, header=True, **RAW)
    return readers.read_labelled_pairs(spark, path, "mrpc").select("text_a", "text_b", "label")


def _labelled_layout(layout, split, width, places, header, languages=False):
    """A layout written with the halves of lines at ``places`` (text_a, text_b, label) and read back."""
    def query(spark, sf):
        path = staged_path(spark, f"labelled-{layout}")
        halves = v.fusion(spark, sf).filter(F.size("sources") == 2)
        label = F.when(v.digit(71, 1, F.col("pair_id")) < "8", "contradictory").otherwise("neutral")
        cells = dict.fromkeys(range(width), F.lit("-")) | dict(zip(places, (F.col("sources")[0], F.col("sources")[1], label)))
        if languages:
            cells[0] = F.when(v.digit(71, 1, F.col("pair_id")) < "4", "en").otherwise("zh")
        halves.select(*[c.alias(f"c{i}") for i, c in cells.items()]).write.csv(path, header=header, **RAW)
        return readers.read_labelled_pairs(spark, path, layout, split).select("text_a", "text_b", "label")

    return query


def _sql_labelled(label, text_b="array_to_string(two, ' ')", kept="true"):
    digit = v.sql_digit(71, 1, "pair_id")
    return f"""WITH {v.FUSION} SELECT array_to_string(one, ' ') AS text_a, {text_b} AS text_b, CASE WHEN {digit} < '8' THEN '{label}' ELSE 'neutral' END AS label
FROM fusion WHERE len(two) > 0 AND {kept.format(digit=digit)}"""


def read_meaning_rows(spark, sf):
    """Rows of three columns; lines with fewer are left out."""
    path = staged_path(spark, "meaning-rows")
    label = F.when(v.digit(72, 1, F.col("pair_id")) < "8", "0").otherwise("1")
    v.fusion(spark, sf).select(F.concat_ws("\t", F.array_join("sources", "\t"), label)).write.text(path)
    return readers.read_class_rows(spark, path, "meaning").select("source", "summary", "label")


MEANING_ROWS = f"""WITH {v.FUSION} SELECT array_to_string(one, ' ') AS source, array_to_string(two, ' ') AS summary,
  CASE WHEN {v.sql_digit(72, 1, 'pair_id')} < '8' THEN 0 ELSE 1 END AS label FROM fusion WHERE len(two) > 0"""


LABELLED = f"""WITH {v.FUSION} SELECT array_to_string(one, ' ') AS text_a, array_to_string(two, ' ') AS text_b,
  CASE WHEN {v.sql_digit(71, 1, 'pair_id')} < '8' THEN '0' ELSE '1' END AS label FROM fusion WHERE len(two) > 0"""


def read_vocab(spark, sf):
    path = staged_path(spark, "vocab")
    f.word_vocabulary(spark, sf).coalesce(1).sortWithinPartitions("token_id").select("token").write.text(path)
    return readers.read_vocab(spark, path)


def write_coverage_log(spark, sf):
    path = staged_path(spark, "coverage")
    writers.write_coverage_log(e.coverage_curve(spark, sf), path)
    return spark.read.csv(path, schema="k bigint, freq bigint, coverage string, phrase string", header=True, sep="\t")


COVERAGE_LOG = f"SELECT k, freq, printf('%.2f', coverage) AS coverage, phrase FROM ({e.COVERAGE})"


QUERIES = {
    "read_pairs": (read_pairs, PAIRS),
    "write_pairs": (write_pairs, PAIRS),
    "write_splits": (write_splits, p.SPLIT),
    "read_fusion": (read_fusion, FUSION),
    "read_rated_rows": (read_rated_rows, RATED),
    "read_compression_json": (read_compression_json, PAIRS),
    "read_predictions": (read_predictions, PREDICTIONS),
    "read_sentence_documents": (read_sentence_documents, DOCUMENTS),
    "read_bar_pairs": (read_bar_pairs, BARS),
    "read_headline_csvs": (read_headline_csvs, HEADLINES),
    "read_title_tldr": (read_title_tldr, f"WITH {v.CHAT_PAIRS} SELECT source, target FROM chat_pairs"),
    "read_acceptability": (read_acceptability, CLASS_ROWS),
    "read_labelled_pairs": (read_labelled_pairs, LABELLED),
    "read_labelled_nli_zh": (_labelled_layout("nli_zh", "train", 3, (0, 1, 2), True), _sql_labelled("contradiction")),
    "read_labelled_nli_zh_dev": (_labelled_layout("nli_zh", "dev", 8, (6, 7, 1), True, True), _sql_labelled("contradictory", kept="{digit} >= '4'")),
    "read_labelled_mnli": (_labelled_layout("mnli", "dev", 12, (8, 9, 11), True), _sql_labelled("contradictory")),
    "read_labelled_cola": (_labelled_layout("cola", "train", 4, (3, 2, 1), False), _sql_labelled("contradictory", "NULL")),
    "read_meaning_rows": (read_meaning_rows, MEANING_ROWS),
    "read_vocab": (read_vocab, f"WITH {f.VOCAB} SELECT token, token_id FROM vocab"),
    "write_coverage_log": (write_coverage_log, COVERAGE_LOG),
    "read_keyword_table": (read_keyword_table, KEYWORDS),
    "read_class_rows": (read_class_rows, CLASS_ROWS),
    "read_class_predictions": (read_class_predictions, s.CLASS_REPORT),
    "read_qa_json": (read_qa_json, QA_JSON),
    "write_clusters": (write_clusters, s.CLUSTERS),
    "write_label_map": (write_label_map, e.LABEL_MAP),
    "write_class_mix": (write_class_mix, CLASS_MIX),
    "write_features": (write_features, FEATURES),
    "write_prediction_table": (write_prediction_table, WIDE),
    "score_table": (score_table, SCORE_TABLE),
    "write_score_table": (write_score_table, SCORE_TABLE),
    "write_qa_predictions": (write_qa_predictions, QA_PREDICTIONS),
    "write_probabilities": (write_probabilities, PROBABILITIES),
}
