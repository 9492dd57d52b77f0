"""Readers of the file formats around the pipeline. Schemas are fixed, nothing is inferred.

Rows that need a position get ``row_id`` from ``monotonically_increasing_id``: unique, in
the order of the lines of a file, not dense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from redpen.functions.text import SPACE
from redpen.operators.ranking import union_all

RAW_TSV = {"sep": "\t", "quote": "", "escape": ""}
# line breaks inside quotes would tie a file to one task; cleaned texts have none
NO_SEPARATOR = "\u0001\u0002\u0001"  # control characters that no text holds
QUOTED_TSV = {"sep": "\t", "quote": '"', "escape": '"'}


def _named(names: str) -> str:
    return ", ".join(f"{n} string" for n in names.split())


def _numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).withColumnRenamed("value", "line")


def _empty_for_null(*names: str) -> list[Column]:
    return [F.coalesce(F.col(n), F.lit("")).alias(n) for n in names]


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw two-column TSV: one source and a target."""
    raw = spark.read.csv(path, schema=_named("source target"), **RAW_TSV)
    return _numbered(raw.select(F.array(_empty_for_null("source")[0]).alias("sources"), *_empty_for_null("target")))


def read_quoted_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quoted two-column TSV as the preparation jobs write it."""
    raw = spark.read.csv(path, schema=_named("source target"), **QUOTED_TSV)
    return _numbered(raw.select(*_empty_for_null("source", "target")))


FUSION_COLUMNS = (
    "coherent_1 coherent_2 incoherent_1 incoherent_2 discourse_type connective has_coref_pronoun has_coref_nominal"
)


def read_fusion(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Eight-column raw TSV with header: two sources, and the coherent text as target."""
    raw = spark.read.csv(path, schema=_named(FUSION_COLUMNS), header=True, **RAW_TSV)
    c1, c2, s1, s2 = _empty_for_null("coherent_1", "coherent_2", "incoherent_1", "incoherent_2")
    return _numbered(raw.select(F.array(s1, s2).alias("sources"), F.trim(F.concat_ws(" ", c1, c2)).alias("target")))


def read_rated_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of the rated-summary files, in the order of the files given."""
    parts = [_numbered(_lines(spark, p)).withColumn("part", F.lit(i)) for i, p in enumerate(paths)]
    return union_all(parts)


def read_compression_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Pretty-printed records parted by blank lines: first sentence as source, headline as target.

    Records are cut at the blank lines before they are parsed, so large files are split.
    """
    schema = "graph struct<sentence:string>, headline string, sentence string"
    raw = spark.read.text(paths, lineSep="\n\n").filter(F.trim("value", F.lit(" \n\r\t")) != "")
    parsed = raw.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
    source = F.coalesce(F.col("r.graph.sentence"), F.col("r.sentence"))
    return _numbered(parsed.select(source.alias("source"), F.col("r.headline").alias("target")))


def read_headline_csvs(spark: SparkSession, path_wide: str, path_short: str) -> DataFrame:
    """Two Latin-1 CSV files with ``headlines`` and ``text`` among their columns, united.

    Texts hold line breaks, so a file is read by one task; its rows are dealt out right after. Give
    many files for scale.
    """
    parts = []
    for path in (path_wide, path_short):
        raw = spark.read.csv(path, header=True, encoding="ISO-8859-1", multiLine=True, quote='"', escape='"')
        parts.append(raw.select(F.col("text").alias("source"), F.col("headlines").alias("target")))
    return _numbered(union_all(parts)).repartition("row_id")


def read_title_tldr(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """JSON records: ``tldr`` as source, ``title`` as target."""
    raw = spark.read.json(path, schema="tldr string, title string")
    return _numbered(raw.select(F.col("tldr").alias("source"), F.col("title").alias("target")))


def read_acceptability(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Four-column TSV: label in the second, sentence in the fourth."""
    raw = spark.read.csv(path, schema="src string, label int, mark string, text string", **QUOTED_TSV)
    return _numbered(raw.select("text", "label"))


def _labelled_layout(layout: str, split: str, language: str):
    """(text_a, text_b, label, row filter, header) of a layout; a test split has no labels."""
    cell = lambda i: F.get("cells", F.lit(i))
    last = F.element_at("cells", -1)
    none = F.lit(None).cast("string")
    if layout == "nli_zh":
        fixed = F.when(cell(2) == "contradictory", "contradiction").otherwise(cell(2))
        if split == "train":
            return cell(0), cell(1), fixed, F.lit(True), True
        return cell(6), cell(7), cell(1), cell(0) == language, True
    if layout == "mnli":
        return cell(8), cell(9), F.lit("contradiction") if split == "test" else last, F.lit(True), True
    if layout == "mrpc":
        return cell(3), cell(4), F.lit("0") if split == "test" else cell(0), F.lit(True), True
    if layout == "cola":
        if split == "test":
            return cell(1), none, F.lit("0"), F.lit(True), True
        return cell(3), none, cell(1), F.lit(True), False
    raise ValueError(f"unknown layout {layout}")


def read_labelled_pairs(
    spark: SparkSession, path: str, layout: str, split: str = "train", language: str = "zh"
) -> DataFrame:
    """``guid, text_a, text_b, label`` from the layouts nli_zh, mnli, mrpc and cola."""
    text_a, text_b, label, kept, header = _labelled_layout(layout, split, language)
    # read as a table of one column, because that reader knows which block of a file holds the header
    lines = spark.read.csv(path, schema="value string", header=header, sep=NO_SEPARATOR, quote="", escape="")
    raw = _numbered(lines.select(F.split("value", "\t").alias("cells")))
    guid = F.concat(F.lit(f"{split}-"), F.col("row_id").cast("string"))
    return raw.filter(kept).select(guid.alias("guid"), text_a.alias("text_a"), text_b.alias("text_b"), label.alias("label"))


def read_review_dir(spark: SparkSession, directory: str) -> DataFrame:
    """One file per review below ``pos`` and ``neg``: text, rating from the name, polarity.

    The sample is taken by ``sample_rows`` with ``file`` as key.
    """
    path = F.col("_metadata.file_path")
    raw = spark.read.text([f"{directory}/pos", f"{directory}/neg"], wholetext=True)
    return raw.select(
        F.col("value").alias("sentence"),
        F.regexp_extract(path, r"\d+_(\d+)\.txt$", 1).alias("sentiment"),
        F.when(path.contains("/pos/"), 1).otherwise(0).alias("polarity"),
        path.alias("file"),
    )


QA_SCHEMA = (
    "data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<id:string, "
    "question:string, is_impossible:boolean, answers:array<struct<text:string, answer_start:int>>>>>>>>"
)


def read_qa_json(spark: SparkSession, path: str | list[str], training: bool, with_negative: bool = False) -> DataFrame:
    """Questions of nested documents. The format is one object per file, read by one task; its questions are
    dealt out right after. Give many files for scale."""
    return qa_rows(spark.read.json(path, schema=QA_SCHEMA, multiLine=True), training, with_negative).repartition("question_id")


def qa_rows(raw: DataFrame, training: bool, with_negative: bool = False) -> DataFrame:
    """One row per question of ``data``; in training every answerable one has exactly one answer."""
    paragraphs = raw.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    rows = paragraphs.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    impossible = F.coalesce(F.col("q.is_impossible"), F.lit(False)) if with_negative and training else F.lit(False)
    rows = rows.select(
        F.col("q.id").alias("question_id"), F.col("q.question").alias("question"), "context",
        impossible.alias("is_impossible"), F.col("q.answers").alias("answers"),
    )
    if not training:
        return rows.drop("answers")
    one = F.when(F.col("is_impossible"), F.lit(None)).when(F.size("answers") == 1, F.col("answers")[0]).otherwise(
        F.raise_error(F.concat(F.lit("exactly one answer expected for "), F.col("question_id")))
    )
    return rows.withColumn("_a", one).select(
        "question_id", "question", "context", "is_impossible",
        F.coalesce(F.col("_a.text"), F.lit("")).alias("answer_text"), F.col("_a.answer_start").alias("answer_start"),
    )


def read_predictions(spark: SparkSession, path: str | list[str], lowercase: bool = False) -> DataFrame:
    """Raw TSV: source, prediction and one or more targets."""
    line = F.lower("line") if lowercase else F.col("line")
    rows = _numbered(_lines(spark, path)).select("row_id", F.split(line, "\t").alias("c"))
    return rows.select(
        "row_id", F.col("c")[0].alias("source"), F.col("c")[1].alias("prediction"),
        F.slice("c", F.lit(3), F.greatest(F.size("c") - 2, F.lit(0))).alias("targets"),
    )


def read_class_predictions(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """TSV whose last two columns are prediction and target."""
    rows = _numbered(_lines(spark, path)).select("row_id", F.split("line", "\t").alias("c"))
    return rows.select(
        "row_id", F.element_at("c", -2).cast("int").alias("prediction"), F.element_at("c", -1).cast("int").alias("target")
    )


def read_keyword_table(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Quoted TSV with header: ``row_id, keyword`` and one column per model; also the model names."""
    raw = spark.read.csv(path, header=True, nullValue="\u0000", emptyValue="", **QUOTED_TSV)
    first, *models = raw.columns
    table = raw.select(
        F.col(f"`{first}`").alias("keyword"), *[F.coalesce(F.col(f"`{m}`"), F.lit("")).alias(m) for m in models]
    )
    return _numbered(table), models


def read_sentence_documents(spark: SparkSession, paths: str) -> DataFrame:
    """``doc_id, sentences``: lines of text, documents parted by blank lines; comma-separated globs."""
    raw = spark.read.text(paths.split(","), lineSep="\n\n")
    # a part may still hold separators made of blanks
    blocks = F.split("value", rf"(?U)\n[\s\x1c-\x1f&&[^\n]]*(\n[\s\x1c-\x1f&&[^\n]]*)*\n")
    docs = raw.select(F.explode(blocks).alias("block"))
    edge = rf"(?U)^{SPACE}+|{SPACE}+$"
    sentences = F.filter(
        F.transform(F.split("block", "\n"), lambda s: F.regexp_replace(s, edge, "")), lambda s: s != ""
    )
    docs = docs.select(sentences.alias("sentences")).filter(F.size("sentences") > 0)
    return _numbered(docs, "doc_id")


def read_bar_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines ``a ||| b``, split at the last bars, or single texts."""
    line = F.trim("line")
    bars = r"^(.*) \|\|\| (.*)$"
    paired = line.rlike(bars)
    return _numbered(_lines(spark, path)).select(
        "row_id",
        F.when(paired, F.regexp_extract(line, bars, 1)).otherwise(line).alias("text_a"),
        F.when(paired, F.regexp_extract(line, bars, 2)).alias("text_b"),
    )


def _whole_file(spark: SparkSession, path: str) -> DataFrame:
    """A dimension table as ``pos, line``: its files one after the other in the order of their names.

    Such files are small by nature and read in one piece each.
    """
    raw = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", r"\n\z", "").alias("value"), F.col("_metadata.file_path").alias("file"))
    lines = raw.filter("value <> ''").select("file", F.split("value", "\n").alias("lines"))
    before = F.sum(F.size("lines")).over(Window.orderBy("file")) - F.size("lines")  # one row per file
    return lines.withColumn("start", before).select("start", F.posexplode("lines").alias("at", "line")).select((F.col("start") + F.col("at")).cast("int").alias("pos"), "line")


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    """``tag, tag_id`` from a JSON object, or from one tag per line; a second blank line is an error."""
    if path.endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", "map<string,int>")).alias("tag", "tag_id"))
    lines = _whole_file(spark, path)
    blank = F.trim("line") == ""
    if lines.agg(F.count_if(blank)).first()[0] > 1:
        raise ValueError("the label map has more than one blank line")
    kept = lines.filter(~blank).agg(F.array_sort(F.collect_list(F.struct("pos", F.trim("line").alias("tag")))).alias("rows"))
    return kept.select(F.posexplode("rows").alias("tag_id", "r")).select("r.tag", "tag_id")


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``token, token_id`` with the line number as id; the last of equal tokens wins."""
    lines = _whole_file(spark, path)
    return lines.groupBy(F.trim("line").alias("token")).agg(F.max("pos").alias("token_id"))


def read_class_rows(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Grammar rows (text, label) or meaning rows (source, summary, label).

    Meaning rows without exactly three columns are left out, as the format prescribes.
    """
    rows = _numbered(_lines(spark, path)).select("row_id", F.split("line", "\t").alias("c"))
    if kind == "grammar":
        return rows.select("row_id", F.col("c")[0].alias("text"), F.col("c")[1].cast("int").alias("label"))
    if kind == "meaning":
        return rows.filter(F.size("c") == 3).select(
            "row_id", F.col("c")[0].alias("source"), F.col("c")[1].alias("summary"), F.col("c")[2].cast("int").alias("label")
        )
    raise ValueError(f"unknown kind {kind}")
