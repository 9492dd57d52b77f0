"""Mining the phrases that must be inserted, their ranking, coverage and the label map."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from redpen.functions.kernels import added_phrases_udf
from redpen.functions.text import tokens
from redpen.operators.lookup import Lookup
from redpen.operators.ranking import running_total
from redpen.session import stage

NEVER = 1 << 30  # rank of a phrase outside the listed ones


def added_phrases(df: DataFrame, key: str = "pair_id", try_swap: bool = False) -> DataFrame:
    """``key, phrases``: what the target adds to the sources (``sources`` array, ``target``)."""
    mine = added_phrases_udf(try_swap)
    return df.select(key, mine(F.col("sources"), F.col("target")).alias("phrases"))


def phrase_rows(mined: DataFrame, key: str = "pair_id") -> DataFrame:
    return mined.select(key, F.posexplode("phrases").alias("pos", "phrase"))


def phrase_counts(mined: DataFrame, key: str = "pair_id") -> DataFrame:
    """Frequency and first occurrence of every phrase; both combine map-side."""
    return phrase_rows(mined, key).groupBy("phrase").agg(
        F.count(F.lit(1)).alias("freq"), F.min(F.struct(F.col(key).alias("example_id"), "pos")).alias("first")
    )


def phrase_vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent phrases with their rank; ties go to the phrase seen first."""
    best = counts.orderBy(F.desc("freq"), "first").limit(size)
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), "first"))
    return best.select("phrase", "freq", rank.alias("rank"))


def coverage_curve(mined: DataFrame, vocabulary: DataFrame, key: str = "pair_id") -> DataFrame:
    """``k, freq, coverage, phrase``: share of examples whose phrases all rank at most k.

    An example is covered from the worst rank among its phrases on, so a histogram of
    worst ranks and its running sum give the whole curve. Ranks are looked up where the examples lie if the vocabulary is small
    enough to travel, and by a join otherwise; the running sum goes over slices of ranks.
    """
    ranks = Lookup(vocabulary.select("phrase", "rank"), "phrase", "rank", default=NEVER)
    ranked = ranks.add(mined.select(key, F.coalesce("phrases", F.expr("cast(array() as array<string>)")).alias("phrases")), "ranks", F.col("phrases"))
    worst = ranked.select(F.coalesce(F.array_max("ranks"), F.lit(0)).cast("long").alias("rank"))
    histogram = stage(worst.groupBy("rank").agg(F.count(F.lit(1)).alias("examples")), "worst-ranks")
    total = histogram.agg(F.coalesce(F.sum("examples"), F.lit(0))).first()[0]
    listed = vocabulary.select(F.col("rank").cast("long").alias("rank"), "phrase", "freq")
    joined = histogram.join(listed, "rank", "full_outer").withColumn("examples", F.coalesce("examples", F.lit(0)).cast("long"))
    summed = running_total(stage(joined, "coverage"), "rank", "examples", "before")
    share = F.lit(100.0) * (F.col("before") + F.col("examples")) / F.nullif(F.lit(total), F.lit(0))
    return summed.filter(F.col("phrase").isNotNull()).select(F.col("rank").cast("int").alias("k"), "freq", share.alias("coverage"), "phrase")


def label_map_table(vocabulary: DataFrame, size: int, swap: bool) -> DataFrame:
    """``tag, tag_id``: the fixed tags, then two tags per phrase in rank order."""
    fixed = ["KEEP", "DELETE"] + (["SWAP"] if swap else [])
    spark = vocabulary.sparkSession
    head = spark.createDataFrame(list(zip(fixed, range(len(fixed)))), "tag string, tag_id int")
    kinds = F.posexplode(F.array(F.lit("KEEP"), F.lit("DELETE"))).alias("side", "kind")
    added = vocabulary.filter(F.col("rank") <= size).select("phrase", "rank", kinds)
    return head.unionByName(
        added.select(
            F.concat_ws("|", "kind", "phrase").alias("tag"),
            (F.lit(len(fixed)) + 2 * (F.col("rank") - 1) + F.col("side")).cast("int").alias("tag_id"),
        )
    )


def parse_tags(label_map: DataFrame) -> DataFrame:
    """Split tags at the first bar into ``kind`` and ``phrase``; an unknown kind is an error."""
    parts = label_map.withColumn("_p", F.split("tag", r"\|", 2))
    kind = F.col("_p")[0]
    checked = F.when(kind.isin("KEEP", "DELETE", "SWAP"), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown tag type: "), kind))
    )
    return parts.withColumns({"kind": checked, "phrase": F.coalesce(F.get("_p", F.lit(1)), F.lit(""))}).drop("_p")


def label_map_phrases(label_map: DataFrame) -> DataFrame:
    """Distinct phrases of a label map with their tokens and length."""
    phrases = parse_tags(label_map).filter(F.col("phrase") != "").select("phrase").distinct()
    split = phrases.withColumn("tokens", tokens(F.col("phrase")))
    return split.withColumn("length", F.size("tokens"))


def label_map_summary(label_map: DataFrame) -> DataFrame:
    """Number of phrases, longest phrase and number of distinct phrase tokens."""
    phrases = label_map_phrases(label_map)
    return phrases.agg(
        F.count(F.lit(1)).alias("phrases"),
        F.max("length").cast("bigint").alias("longest"),
        F.size(F.array_distinct(F.flatten(F.collect_list("tokens")))).cast("bigint").alias("tokens"),
    )
