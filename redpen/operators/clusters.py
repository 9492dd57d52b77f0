"""Keywords grouped by their shortened form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from redpen.operators.ranking import join_group_totals
from redpen.session import stage


def unpivot_models(df: DataFrame, models: list[str], key: str = "row_id", keyword: str = "keyword") -> DataFrame:
    """One row per keyword and model: ``row_id, keyword, model, short`` with lower-cased forms."""
    return df.unpivot([key, keyword], models, "model", "short").withColumn("short", F.lower("short"))


def cluster_sizes(long: DataFrame) -> DataFrame:
    """Members per (model, short form), combined map-side; empty forms do not cluster."""
    used = long.filter(F.coalesce("short", F.lit("")) != "")
    return used.groupBy("model", "short").agg(F.count(F.lit(1)).alias("size"))


def keyword_clusters(long: DataFrame, key: str = "row_id") -> DataFrame:
    """Member rows of clusters of two or more: ``model, short, size, row_id, keyword``.

    One row per member, in ``row_id`` order within a cluster, so a cluster that holds a
    large part of the table is never one value or one task.
    """
    sizes = stage(cluster_sizes(long).filter(F.col("size") > 1), "cluster-sizes")  # read three times below
    used = long.filter(F.coalesce("short", F.lit("")) != "")
    members = join_group_totals(used, sizes, ["model", "short"], "size")
    return members.select("model", "short", "size", key, "keyword")


def cluster_summary(long: DataFrame) -> DataFrame:
    """Per model: keywords in clusters of two or more, next to all keywords."""
    used = cluster_sizes(long).groupBy("model").agg(
        F.sum(F.when(F.col("size") > 1, F.col("size")).otherwise(0)).alias("clustered")
    )
    totals = long.groupBy("model").agg(F.count(F.lit(1)).alias("total"))
    return totals.join(used, "model", "left").select(
        "model", F.coalesce("clustered", F.lit(0)).alias("clustered"), "total"
    )
