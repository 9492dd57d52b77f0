"""Cleaning, filtering and tokenising tables of source and target texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from redpen.functions import text


def clean_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rewrite the named columns: separators collapsed, edge marks and line breaks removed."""
    return df.withColumns({c: text.cleaned(F.col(c)) for c in cols})


def _blank(col: str) -> Column:
    return ~F.coalesce(F.col(col).rlike(text.NOT_SPACE), F.lit(False))


def drop_empty_pairs(
    df: DataFrame, source: str = "source", target: str = "target", seen: Observation | None = None
) -> DataFrame:
    """Keep pairs with tokens on both sides; ``seen`` receives the number dropped."""
    empty = _blank(source) | _blank(target)
    if seen is not None:
        df = df.observe(seen, F.count_if(empty).alias("dropped"), F.count(F.lit(1)).alias("total"))
    return df.filter(~empty)


def validate_pairs(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Raise when a side is missing or has no tokens; otherwise hand the table on."""
    row = df.agg(
        F.count_if(_blank(source)).alias("sources"), F.count_if(_blank(target)).alias("targets")
    ).first()
    if row.sources or row.targets:
        raise ValueError(f"empty texts: {row.sources} sources, {row.targets} targets")
    return df


def tokenize_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Add ``<col>_spaced`` and ``<col>_tokens`` with Treebank-style tokens."""
    spaced = {f"{c}_spaced": text.treebank(F.col(c)) for c in cols}
    return df.withColumns(spaced).withColumns(
        {f"{c}_tokens": text.tokens(F.col(f"{c}_spaced")) for c in cols}
    )


def token_table(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """One row per whitespace token with its position."""
    return df.select(*keys, F.posexplode(text.tokens(F.col(col))).alias("pos", "token"))


def mask_tokens(df: DataFrame, col: str = "pieces") -> DataFrame:
    """Replace numbers and symbols in a list of pieces by their place-holders."""
    return df.withColumn(col, F.transform(F.col(col), text.masked_piece))
