"""Input views on the driver tables, each as a DataFrame and as SQL for the check.

Every view reads whole tables and whole texts. Hashes stand in for chance, so both
engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from redpen.functions import text
from redpen.functions.hashing import digest
from redpen.functions.kernels import INSERTS, edited_texts_udf, edits_udf, halves_target_udf, halves_udf

LINES_PER_DOC = 1 << 24


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give every core a share when the scan has fewer partitions than there are cores.

    Large inputs come in enough partitions and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, '\\s+'), lambda t: t <> '')"


def digit(seed: int, at: int, *parts: Column) -> Column:
    """One hex digit of a seeded hash."""
    return F.substring(digest(seed, *parts), at, 1)


def sql_digit(seed: int, at: int, *parts: str) -> str:
    joined = ", ':', ".join(parts)
    return f"substr(md5(concat('{seed}:', {joined})), {at}, 1)"


def sql_uniform(seed: int, *parts: str) -> str:
    joined = ", ':', ".join(parts)
    return f"(('0x' || substr(md5(concat('{seed}:', {joined})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# ------------------------------------------------------------------ lines of documents

def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document that has tokens: ``doc_id, line, pair_id, text, toks``."""
    docs = documents(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    keyed = docs.withColumn("pair_id", F.col("doc_id") * LINES_PER_DOC + F.col("line"))
    # asked of the text, as a filter on the tokens would be pushed below them and cut each line twice
    return keyed.filter(F.col("text").rlike(text.NOT_SPACE)).withColumn("toks", text.tokens(F.col("text")))


LINES = f"""lines AS (
  SELECT doc_id, i - 1 AS line, doc_id * {LINES_PER_DOC} + i - 1 AS pair_id, ls[i] AS text,
         {sql_tokens('ls[i]')} AS toks
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
  WHERE len({sql_tokens('ls[i]')}) > 0)"""


# ------------------------------------------------------------------ edited copies

# where in a token's hash the two digits lie that decide its fate, per copy
TARGET, SECOND_TARGET, MODEL_1, MODEL_2 = 1, 3, 5, 7


def edited_texts(own: Column, key: Column, *slots: int) -> Column:
    """A text with single spaces and one edited copy per slot; about 3/16 of the tokens are deleted and 1/16 replaced."""
    return edited_texts_udf(list(slots))(own, key)


def sql_hashed(toks: str, key: str) -> str:
    return f"list_transform({toks}, lambda t, i: {{'t': t, 'h': md5(concat('7:', {key}, ':', i - 1))}})"


def sql_edited(marked: str, slot: int) -> str:
    return f"""list_transform(list_filter({marked}, lambda x: x.h[{slot}] NOT IN ('0', '1', '2')),
      lambda x: {{'t': CASE WHEN x.h[{slot}] <> '3' THEN x.t WHEN x.h[{slot + 1}] < '8' THEN '{INSERTS[0]}'
        WHEN x.h[{slot + 1}] < 'c' THEN '{INSERTS[1]}' WHEN x.h[{slot + 1}] < 'e' THEN '{INSERTS[2]}' ELSE '{INSERTS[3]}' END,
        'new': x.h[{slot}] = '3'}})"""


def words_of(edits: Column) -> Column:
    return F.transform(edits, lambda x: x["t"])


def joined_words(edits: Column) -> Column:
    return text.spaced(words_of(edits))


def sql_joined(edits: str) -> str:
    return f"array_to_string(list_transform({edits}, lambda x: x.t), ' ')"


def edit_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as sources with an edited copy as target: ``pair_id, toks, edits, source, target``."""
    # who needs the texts only pays for the first kernel only, who needs the edits for the second
    copies = edited_texts(F.col("text"), F.col("pair_id"), TARGET)
    step = lines(spark, sf).withColumns({"copies": copies, "edits": edits_udf(TARGET)("toks", "pair_id")})
    return step.select("pair_id", "toks", "edits", F.get("copies", F.lit(0)).alias("source"), F.get("copies", F.lit(1)).alias("target"))


EDIT_PAIRS = f"""{LINES}, edit_pairs AS (
  SELECT pair_id, toks, edits, array_to_string(toks, ' ') AS source, {sql_joined('edits')} AS target
  FROM (SELECT pair_id, toks, {sql_edited(sql_hashed('toks', 'pair_id'), TARGET)} AS edits FROM lines))"""


def fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Lines cut into two sources in the middle; half of the targets start with the second part."""
    # who does not need the targets does not pay for their hashes
    return lines(spark, sf).select("pair_id", halves_udf()("text").alias("sources"), halves_target_udf(TARGET)("text", "pair_id").alias("target"))


FUSION = f"""{LINES}, fusion AS (
  SELECT pair_id, CASE WHEN len(two) > 0 THEN [array_to_string(one, ' '), array_to_string(two, ' ')]
           ELSE [array_to_string(one, ' ')] END AS sources, one, two
  FROM (SELECT pair_id, toks[1:ceil(len(toks) / 2.0)::INT] AS one, toks[ceil(len(toks) / 2.0)::INT + 1:] AS two FROM lines))"""


# ------------------------------------------------------------------ chat pairs

def chat_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    chat = table(spark, sf, "conversations")
    asked = chat.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    answered = chat.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target")
    )
    return asked.join(answered, ["conv_id", "turn"])


CHAT_PAIRS = """chat_pairs AS (
  SELECT u.conv_id, u.turn, u.text AS source, a.text AS target
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


# ------------------------------------------------------------------ predictions

MODELS = {"m1": MODEL_1, "m2": MODEL_2}


def prediction_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Two models and two targets per line: ``row_id, source, predictions, targets``."""
    key = F.col("pair_id")
    base = lines(spark, sf).withColumn("copies", edited_texts(F.col("text"), key, TARGET, SECOND_TARGET, *MODELS.values()))
    made = F.array(*[F.struct(F.lit(m).alias("model"), F.get("copies", F.lit(3 + i)).alias("prediction")) for i, m in enumerate(MODELS)])
    return base.select(
        key.alias("row_id"), F.get("copies", F.lit(0)).alias("source"), F.slice("copies", 2, 2).alias("targets"), made.alias("predictions")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per model: ``row_id, model, source, prediction, targets``."""
    step = prediction_lists(spark, sf).select("row_id", "source", "targets", F.explode("predictions").alias("x"))
    return step.select("row_id", "x.model", "source", "x.prediction", "targets")


PREDICTIONS = f"""{LINES}, predictions AS (
  SELECT pair_id AS row_id, model, array_to_string(toks, ' ') AS source, CASE model WHEN 'm1' THEN p1 ELSE p2 END AS prediction,
         targets
  FROM (SELECT pair_id, toks, {sql_joined(sql_edited('marked', MODEL_1))} AS p1,
               {sql_joined(sql_edited('marked', MODEL_2))} AS p2,
               [{sql_joined(sql_edited('marked', TARGET))}, {sql_joined(sql_edited('marked', SECOND_TARGET))}] AS targets
        FROM (SELECT *, {sql_hashed('toks', 'pair_id')} AS marked FROM lines)), (VALUES ('m1'), ('m2')) AS models(model))"""


# ------------------------------------------------------------------ rated lines

# All codes of the rating buckets.
CODES = ["6", "7", "9", "11", "12", "14", "21", "22", "24"]


def _count(limit: int, seed: int, *parts: Column) -> Column:
    return F.pmod(F.conv(F.substring(digest(seed, *parts), 1, 4), 16, 10).cast("int"), F.lit(limit))


def sql_count(limit: int, seed: int, *parts: str) -> str:
    joined = ", ':', ".join(parts)
    return f"(('0x' || substr(md5(concat('{seed}:', {joined})), 1, 4))::INT % {limit})"


def rated_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every document line as a rated row: one to four summaries with up to five codes each."""
    from redpen.operators.ratings import COMMENTS

    comments, codes = F.array(*map(F.lit, COMMENTS)), F.array(*map(F.lit, CODES))
    key, sentence = F.col("pair_id"), F.get("copies", F.lit(0))

    def code_fields(no: Column) -> Column:
        n = _count(6, 31, key, no)

        def one(j: Column) -> Column:
            at = _count(9, 32, key, no, j)
            return F.concat_ws(" ||| ", F.get(codes, at), F.when(j < n, F.get(comments, at)))

        return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one))

    def summary(no: Column) -> Column:
        head = F.concat(F.lit("s"), no.cast("string"), F.lit(" "), sentence)
        return F.concat_ws(" ||| ", head, F.lit("3"), F.lit("2;x"), F.array_join(code_fields(no), " ||| "))

    summaries = F.transform(F.sequence(F.lit(1), _count(4, 30, key) + 1), summary)
    line = F.concat_ws("\t", F.concat_ws(" ||| ", key.cast("string"), F.lit("web"), sentence), F.array_join(summaries, "\t"))
    return lines(spark, sf).withColumn("copies", edited_texts(F.col("text"), key)).select(key.alias("row_id"), line.alias("line"))


_CODE_LIST = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
# the answer comes from the generator, nothing is parsed
RATED = f"""{LINES}, summaries AS (
  SELECT pair_id AS row_id, toks, unnest(range(1, {sql_count(4, 30, 'pair_id')} + 2)) AS no FROM lines), rated AS (
  SELECT row_id, no - 1 AS summary_no, array_to_string(toks, ' ') AS source,
         concat('s', no, ' ', array_to_string(toks, ' ')) AS target,
         list_transform(range(1, {sql_count(6, 31, 'row_id', 'no')} + 1),
           lambda j: {_CODE_LIST}[{sql_count(9, 32, 'row_id', 'no', 'j')} + 1]) AS ratings
  FROM summaries)"""


# ------------------------------------------------------------------ labels and keywords

def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents; the prediction says that long texts are good."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "n_chars")
    marks = table(spark, sf, "labels")
    return docs.join(marks, "doc_id").select(
        "doc_id", "text", "toxic", F.col("quality").alias("target"), (F.col("n_chars") > 1000).cast("int").alias("prediction")
    )


CLASS_PREDICTIONS = """class_predictions AS (
  SELECT d.doc_id, d.text, l.toxic, l.quality AS target, (d.n_chars > 1000)::INT AS prediction
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as keywords with two models' short forms; the second is empty for economy parts."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_id"),
        F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("keyword"),
        F.substring_index("p_name", " ", -1).alias("m1"),
        F.when(F.col("p_type") == "ECONOMY", "").otherwise(F.upper(F.substring_index("p_name", " ", 1))).alias("m2"),
    )


KEYWORDS = """keywords AS (
  SELECT p_partkey AS row_id, concat(p_name, '#', p_partkey) AS keyword, 'm1' AS model,
         lower(split_part(p_name, ' ', -1)) AS short FROM part
  UNION ALL
  SELECT p_partkey, concat(p_name, '#', p_partkey), 'm2',
         CASE WHEN p_type = 'ECONOMY' THEN '' ELSE lower(split_part(p_name, ' ', 1)) END FROM part)"""
