"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from redpen.session import stage


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of the links ``a, b``: the smallest node it reaches.

    Star contraction: nodes hang their larger neighbours below the smallest neighbour, then the smaller
    ones, until nothing moves. That takes a logarithmic number of passes; each reads
    a written table, so lost executors cost one pass at most. Links may repeat, and lead to themselves.
    """
    edges = links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi is not null and lo is not null")
    edges = stage(edges.filter("hi <> lo").distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.filter("hi <> lo").distinct()
        smallest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(smallest, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        edges = stage(small.select("e.hi", "e.lo").filter("hi <> lo").distinct(), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.xxhash64("lo", "hi") % 1_000_003)).first())
