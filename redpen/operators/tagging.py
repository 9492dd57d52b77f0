"""Targets as per-token edit tags, and texts realised from tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions.kernels import parts_udf, row_tags_udf, spans_udf, tags_udf
from redpen.functions.text import lower_first, spaced, tokens, upper_first
from redpen.operators.lookup import Lookup, key_filter, travelling, with_found
from redpen.operators.vocabulary import label_map_phrases, parse_tags

def source_tokens(sources: Column) -> Column:
    return F.flatten(F.transform(sources, tokens))


def first_tokens(sources: Column) -> Column:
    """Start of each source in the concatenated tokens (one or two sources)."""
    return F.when(F.size(sources) == 2, F.array(F.lit(0), F.size(tokens(F.get(sources, F.lit(0)))))).otherwise(
        F.array(F.lit(0))
    )


def tag_pairs(df: DataFrame, label_map: DataFrame, do_swap: bool = True) -> DataFrame:
    """Add ``tokens, tags, feasible, swapped`` to ``sources, target``.

    Phrases of a label map that is small enough travel to the tasks. With a larger one the spans of each target that may be
    asked for are joined with the phrases, and the tags are decided from what was found.
    """
    phrases = label_map_phrases(label_map)
    listed = travelling(phrases.select("phrase"))
    if listed is not None:
        held = df.sparkSession.sparkContext.broadcast([r["phrase"] for r in listed])
        tagged = df.withColumn("_t", tags_udf(held, do_swap)(F.col("sources"), F.col("target")))
    else:
        lowered = phrases.select(F.lower("phrase").alias("phrase"), "length").groupBy("phrase").agg(F.max("length").alias("length"))
        longest = lowered.agg(F.max("length")).first()[0]
        bitmap = df.sparkSession.sparkContext.broadcast(key_filter(lowered, "phrase"))
        asked = df.withColumn("_asked", spans_udf(bitmap, longest)(F.col("sources"), F.col("target")))
        found = with_found(asked, "_asked", lowered, "phrase", "length")
        tag = row_tags_udf(do_swap)(F.col("sources"), F.col("target"), F.col("found_keys"))
        tagged = found.withColumn("_t", tag).drop("_asked", "found_keys", "found_values")
    return (
        tagged.withColumns({
            "tokens": source_tokens(F.col("sources")),
            "tags": F.col("_t.tags"),
            "swapped": F.col("_t.swapped"),
            "feasible": F.size("_t.tags") > 0,
        })
        .drop("_t")
    )


def apply_infeasible_policy(df: DataFrame, policy: str) -> DataFrame:
    """``train`` drops rows without tags, ``tune`` alternates KEEP and DELETE, ``predict`` keeps all."""
    if policy == "train":
        return df.filter("feasible")
    if policy == "tune":
        stand_in = F.transform("tokens", lambda t, i: F.when(i % 2 == 0, "KEEP").otherwise("DELETE"))
        return df.withColumn("tags", F.when(F.col("feasible"), F.col("tags")).otherwise(stand_in))
    if policy == "predict":
        return df.withColumn("tags", F.transform("tokens", lambda t: F.lit("KEEP")))
    raise ValueError(f"unknown policy {policy}")


def conversion_report(df: DataFrame) -> DataFrame:
    """Rows seen, rows converted to tags and their share."""
    converted = F.count_if("feasible")
    return df.agg(
        F.count(F.lit(1)).alias("seen"),
        converted.alias("converted"),
        F.coalesce(converted / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("rate"),
    )


def tag_report(df: DataFrame) -> DataFrame:
    """``tag, kind, uses`` over the converted rows; counts combine map-side."""
    # an outer explode: a plain one would add a filter that computes the tags a second time
    used = df.filter("feasible").select(F.explode_outer("tags").alias("tag")).filter(F.col("tag").isNotNull())
    return used.groupBy("tag").agg(F.count(F.lit(1)).alias("uses")).select("tag", tag_kind(F.col("tag")).alias("kind"), "uses")


def tag_kind(tag: Column) -> Column:
    return F.substring_index(tag, "|", 1)


def realize(df: DataFrame, sources: str = "sources", tags: str = "tags", out: str = "realized") -> DataFrame:
    """Text from source tokens and tags; a SWAP on the last token of the first source reorders."""
    step = df.withColumn("_p", parts_udf()(sources, tags))
    swap = F.col("_p.swap")
    step = step.withColumns({"_lead": F.when(swap, F.col("_p.b")).otherwise(F.col("_p.a")), "_tail": F.when(swap, F.col("_p.a")).otherwise(F.col("_p.b"))})
    ends = F.col("_lead").rlike(r"(^|[.!?])$")
    cased = F.when(ends, upper_first(F.col("_tail"))).otherwise(lower_first(F.col("_tail")))
    text = F.when(F.size(sources) == 2, F.concat_ws(" ", "_lead", cased)).otherwise(F.col("_p.a"))
    return step.withColumn(out, text).drop("_p", "_lead", "_tail")


# Part-of-speech ids counted as verbs, per tag set.
VERB_IDS = {"full": [28, 29, 30, 31, 32, 33], "concise": [3], None: []}


def token_loss_weights(
    df: DataFrame,
    label_map: DataFrame,
    add: float = 1.0,
    keep: float = 1.0,
    delete: float = 1.0,
    verb: float = 0.0,
    tagset: str | None = None,
) -> DataFrame:
    """Add ``weights``, one per position of ``labels``, from the class of the label.

    A label with a phrase takes the add weight, on top of the weight of its kind; deleting
    a verb (by ``segment_ids``) is weighted by 1 + ``verb``.
    """
    parsed = parse_tags(label_map)
    kinds = F.when(F.col("kind") == "KEEP", 1).when(F.col("kind") == "DELETE", 2).otherwise(0)
    code = (kinds + F.when(F.col("phrase") != "", 4).otherwise(0)).cast("int")
    classes = Lookup(parsed.select("tag_id", code.alias("code")), "tag_id", "code", default=0)
    step = classes.add(df, "_codes", F.col("labels"))

    def weight(x: Column) -> Column:
        kind = x["_codes"].bitwiseAND(F.lit(3))
        return (
            F.when(x["_codes"] >= 4, F.lit(float(add))).otherwise(1.0)
            * F.when(kind == 1, F.lit(float(keep))).otherwise(1.0)
            * F.when(kind == 2, F.lit(float(delete))).otherwise(1.0)
            * F.when((kind == 2) & x["segment_ids"].isin(VERB_IDS[tagset]), F.lit(1.0 + verb)).otherwise(1.0)
        )

    return step.withColumn("weights", F.transform(F.arrays_zip("_codes", "segment_ids"), weight)).drop("_codes")
