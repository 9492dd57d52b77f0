"""Corpus statistics in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import text


def _spread(col: str, name: str) -> list[Column]:
    return [F.avg(col).alias(f"{name}_mean"), F.stddev_pop(col).alias(f"{name}_std")]


def pair_stats(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Word counts, sentences per source, new words per target and compression ratio."""
    lower = {side: text.tokens(F.lower(text.treebank(F.col(side)))) for side in (source, target)}
    measured = df.select(
        F.size(text.tokens(F.col(source))).alias("source_words"),
        F.size(text.tokens(F.col(target))).alias("target_words"),
        lower[source].alias("s"),
        lower[target].alias("t"),
    ).select(
        "source_words",
        "target_words",
        F.greatest(
            F.size(F.filter("s", lambda w: w.isin(".", "!", "?"))), F.lit(1)
        ).alias("sentences"),
        F.size(F.array_except("t", "s")).alias("new_words"),
        (F.col("target_words") / F.col("source_words")).alias("ratio"),
    )
    return measured.agg(
        F.count(F.lit(1)).alias("pairs"),
        *_spread("source_words", "source_words"),
        F.max("source_words").cast("bigint").alias("source_words_max"),
        F.min("source_words").cast("bigint").alias("source_words_min"),
        *_spread("target_words", "target_words"),
        F.max("target_words").cast("bigint").alias("target_words_max"),
        F.min("target_words").cast("bigint").alias("target_words_min"),
        *_spread("sentences", "sentences"),
        *_spread("new_words", "new_words"),
        *_spread("ratio", "ratio"),
    )


def label_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Sample and negative counts with the negative rate."""
    negatives = F.count_if(F.col(label) == 0)
    return df.agg(
        F.count(F.lit(1)).alias("samples"),
        negatives.alias("negatives"),
        (negatives / F.count(F.lit(1))).alias("negative_rate"),
    )
