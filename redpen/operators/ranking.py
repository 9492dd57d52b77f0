"""Exact ranks, dense numbers and hot-key joins without a global sort or a single-task group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.functions.hashing import order_key

BUCKETS = 1 << 16  # rows of a histogram, whatever the table size
EDGE_ROWS = 1 << 14  # rows ordered exactly once the histogram has narrowed the range
HOT_KEYS = 1024  # keys joined by broadcast; any other key holds less than 1/1024 of the rows


def nth_lowest(df: DataFrame, rank: Column, key: str, ns: list[int], low: int, high: int) -> list[tuple]:
    """The (rank, key) of the n-th rows in (rank, key) order; ``low..high`` bounds ``rank``. Keys may repeat; null comes first.

    A pass counts rows per slice of the range (at most 65 536 counts, combined map-side)
    and goes on with the slice that holds the n-th row, until its distinct keys are few. The
    first pass serves all of ``ns``; a second is rarely needed.
    """
    keyed = df.select(rank.alias("rank"), F.col(key).alias("key"))
    passes: dict[tuple[int, int], list] = {}

    def counts(low: int, high: int, width: int) -> list:
        if (low, high) not in passes:
            inside = keyed.filter(F.col("rank").between(low, high))
            # a span beyond 63 bits needs wider arithmetic
            at = f"(rank - {low}L)" if high - low < 1 << 63 else f"(cast(rank as decimal(20, 0)) - cast('{low}' as decimal(20, 0)))"
            sliced = inside.groupBy(F.expr(f"cast({at} div {width} as bigint)").alias("slice"))
            passes[low, high] = sorted(sliced.agg(F.count(F.lit(1)).alias("n")).collect())
        return passes[low, high]

    def find(n: int, low: int, high: int) -> tuple:
        width = (high - low) // BUCKETS + 1
        left = n
        for at, held in counts(low, high, width):
            if left <= held:
                break
            left -= held
        else:
            raise ValueError(f"{n} rows exceed the total sample size of {n - left}")
        low, high = low + at * width, low + (at + 1) * width - 1
        if held > EDGE_ROWS and width > 1:
            return find(left, low, high)
        # repeated keys are one row here, so a slice that cannot be narrowed is small as well
        edge = keyed.filter(F.col("rank").between(low, high)).groupBy("rank", "key").agg(F.count(F.lit(1)).alias("n"))
        for row in edge.orderBy("rank", "key").collect():
            if left <= row["n"]:
                return row["rank"], row["key"]
            left -= row["n"]
        raise RuntimeError("the input changed between two passes")

    return [find(n, low, high) for n in ns]


def _compared(rank: Column, key: str, edge: tuple) -> tuple[Column, Column]:
    """(below, at) the edge in (rank, key) order with null keys first."""
    same = rank == F.lit(edge[0])
    if edge[1] is None:
        return rank < F.lit(edge[0]), same & F.col(key).isNull()
    lower = F.coalesce(F.col(key) < F.lit(edge[1]), F.lit(True))
    return (rank < F.lit(edge[0])) | (same & lower), same & F.coalesce(F.col(key) == F.lit(edge[1]), F.lit(False))


def by_sizes(df: DataFrame, rank: Column, key: str, sizes: list[int], low: int, high: int, name: str) -> DataFrame:
    """Add ``name``: 0 for the first sizes[0] rows in (rank, key) order, 1 for the next sizes[1], and so on; the rest gets len(sizes).

    Sizes are exact whatever the keys: where a border falls among rows with one key, only those rows are
    numbered, inside their partitions and with the counts of the partitions before. Rows are
    labelled where they lie. Which of the rows with the same key come first follows the partitions of the input.
    """
    upto = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    wanted = sorted({n for n in upto if n > 0})
    found = dict(zip(wanted, nth_lowest(df, rank, key, wanted, low, high)))
    edges = sorted(set(found.values()), key=lambda e: (e[0], e[1] is not None, e[1]))
    tests = {e: _compared(rank, key, e) for e in edges}
    tallies = [F.count_if(t) for e in edges for t in tests[e]]
    row = df.agg(*tallies).first() if edges else []
    below, equal = dict(zip(edges, row[::2])), dict(zip(edges, row[1::2]))

    def part(place: Column) -> Column:
        out = F.lit(len(sizes))
        for i in range(len(sizes) - 1, -1, -1):
            out = F.when(place < upto[i], i).otherwise(out)
        return out

    # away from the edges the number of a row matters only up to the next edge
    place = F.lit(upto[-1] if upto else 0)
    for e in reversed(edges):
        under, at = tests[e]
        one = F.lit(below[e])
        before = max((below[x] + equal[x] for x in edges if (below[x], x != e) < (below[e], False) and x != e), default=0)
        place = F.when(at, one).when(under, F.lit(before)).otherwise(place)
    torn = [e for e in edges if equal[e] > 1 and any(below[e] < n < below[e] + equal[e] for n in upto)]
    if not torn:
        return df.withColumn(name, part(place))
    among = reduce(lambda a, b: a | b, [tests[e][1] for e in torn])
    pieces = [df.filter(~among).withColumn(name, part(place))]
    for e in torn:
        rows = df.filter(tests[e][1]).withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
        held = rows.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")  # one row per partition
        starts = held.select("_pid", before.alias("_start"))
        number = F.col("_start") + F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
        numbered = rows.join(F.broadcast(starts), "_pid").withColumn(name, part(number + below[e]))
        pieces.append(numbered.drop("_pid", "_mid", "_start"))
    return union_all(pieces)


def dense_index(df: DataFrame, key: str, seed: int, name: str = "idx") -> DataFrame:
    """Number the rows 0..n-1 in hashed key order and add the row count as ``<name>_n``.

    Rows are numbered inside even slices of the hash range; the start of each slice comes
    from a histogram of at most 65 536 rows, which is the only thing broadcast.
    """
    hashed = df.withColumn("_h", order_key(seed, F.col(key))).withColumn(
        "_b", F.shiftright("_h", 60 - 16).cast("int")
    )
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    ordered = Window.orderBy("_b")
    starts = counts.select(
        "_b",
        (F.sum("_c").over(ordered) - F.col("_c")).alias("_start"),
        F.sum("_c").over(Window.partitionBy()).alias(f"{name}_n"),
    )
    within = Window.partitionBy("_b").orderBy("_h", key)
    return (
        hashed.withColumn("_i", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), "_b")
        .withColumn(name, (F.col("_start") + F.col("_i")).cast("bigint"))
        .drop("_h", "_b", "_i", "_start")
    )


def join_group_totals(df: DataFrame, totals: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Join rows with one total per key although single keys may hold most of the rows.

    The largest keys (a fixed number) are joined by broadcast, so their rows stay where
    they are; what is left has no large group and is shuffled on the keys.
    """
    hot = F.broadcast(totals.orderBy(F.desc(size), *keys).limit(HOT_KEYS))
    of_hot = df.join(hot, keys)
    of_rest = df.join(hot.select(*keys), keys, "left_anti").join(totals, keys)
    return of_hot.unionByName(of_rest)


SLICE_ROWS = 1 << 17  # rows of a running total that one task sums up


def running_total(df: DataFrame, order: str, value: str, name: str, slices: int | None = None) -> DataFrame:
    """Exclusive running total of ``value`` over distinct ``order`` values, sliced by quantiles.

    The number of slices grows with the table, so a slice stays as large as a task can sum up.
    """
    slices = slices or max(16, -(-df.count() // SLICE_ROWS))
    marks = sorted(set(df.stat.approxQuantile(order, [i / slices for i in range(1, slices)], 0.001)))
    at = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < F.col(order))) if marks else F.lit(0)
    sliced = df.withColumn("_b", at)
    totals = sliced.groupBy("_b").agg(F.sum(value).alias("_t"))
    starts = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_start"))
    within = Window.partitionBy("_b").orderBy(order)
    return (
        sliced.withColumn("_in", F.sum(value).over(within) - F.col(value))
        .join(F.broadcast(starts), "_b")
        .withColumn(name, F.col("_start") + F.col("_in"))
        .drop("_b", "_in", "_start")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
