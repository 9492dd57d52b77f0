"""Hard negatives from an inverted multi-index.

A vector is cut into two halves, and each half has a codebook. The pair of its codes is the cell of a vector. For an anchor and a
code, the score of the half is at most the product with the code plus the norm of the anchor's half times the radius of the
code, so the sum of both halves bounds every score of a cell. A heap visits cells by falling bounds (the multi-sequence algorithm)
until no other cell can change the answer: the k best scores, or the k best within a window of scores.

Anchors lie in blocks, cells in chunks of rows. A round gives each anchor the cells it still needs up to a number
of rows; blocks then meet the chunks of their cells, and the best hits set the limits of the next round, whose number is larger.
The last round of an anchor is the one that its limits end, so answers are exact; every row is in the index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.llm import exact
from redpen.llm.topk import usable
from redpen.session import stage

SAMPLE_ROWS = 8192  # vectors that the codebooks are fitted on
MOST_CODES = 256  # of a half; below that the fourth root of the number of rows
STEPS = 8  # of the fit
CHUNK_ROWS = 2048  # rows of a cell that meet a block of anchors together
BLOCK_ROWS = 256  # anchors that go together
HELD_HITS = 200_000  # hits that a task holds before it reduces them
FIRST_ROWS, GROWTH = 8192, 8  # rows that an anchor may look at in the first round, and how that grows

# ---------------------------------------------------------------- codebooks and cells


def fitted(points: np.ndarray, codes: int) -> np.ndarray:
    """Centres of a sample by a few rounds of k-means; deterministic."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(3).permutation(len(distinct))[:codes]]
    for _ in range(STEPS):
        at = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        held = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.where(held > 0, sums / np.maximum(held, 1), centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)


def matrix(column, width: int) -> np.ndarray:
    """Rows of lists of doubles as one matrix, short rows padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Codes:
    """The two codebooks, the radius of each code and the number of rows of each cell."""

    def __init__(self, halves, radii, held):
        self.halves, self.radii, self.held = halves, radii, held
        self.cut = halves[0].shape[1]

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        # scores are compared in whole numbers, bounds in doubles: huge components only make them looser
        x = np.nan_to_num(x.astype(np.float64), posinf=1e300, neginf=-1e300)
        return [x[:, : self.cut], x[:, self.cut :]]

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """For both halves: what each code adds at most to the score of each row."""
        out = []
        with np.errstate(over="ignore", invalid="ignore"):
            for part, centres, radius in zip(self.parts(x), self.halves, self.radii):
                norm = np.sqrt((part**2).sum(1))[:, None]
                size = norm * (np.sqrt((centres**2).sum(1)) + radius)[None, :]
                bound = part @ centres.T + norm * radius[None, :] + 1e-9 * size
                out.append(np.nan_to_num(bound, nan=np.inf, posinf=np.inf, neginf=np.inf))
        return out


def visits(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, code, code) of all cells by falling sums: a heap walks both sorted halves."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)] if x and y else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class Index:
    """Chunks of cells as a written table, and the codes that bound their scores."""

    def __init__(self, rows: DataFrame, n: int, scale: int):
        """``rows`` has ``id, label, v`` with finite components only."""
        spark = rows.sparkSession
        self.scale = scale
        self.width = width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
        sample = rows.select("v").orderBy(F.xxhash64("id", "v")).limit(SAMPLE_ROWS).toArrow()
        points = np.nan_to_num(exact.floored(matrix(sample["v"], width), scale).astype(np.float64), posinf=1e300, neginf=-1e300)
        codes = max(2, min(MOST_CODES, int(n**0.25)))
        with np.errstate(over="ignore", invalid="ignore"):
            halves = [fitted(points[:, : width // 2], codes), fitted(points[:, width // 2 :], codes)]
        sizes = [len(h) for h in halves]
        held = spark.sparkContext.broadcast((halves, width, scale))

        def assign(batches):
            halves, width, scale = held.value
            coder = Codes(halves, None, None)
            for batch in batches:
                x = coder.parts(exact.floored(matrix(batch["v"], width), scale))
                with np.errstate(over="ignore", invalid="ignore"):
                    at = [nearest(part, centres) for part, centres in zip(x, halves)]
                    away = [np.sqrt(((part - centres[i]) ** 2).sum(1)) for part, centres, i in zip(x, halves, at)]
                columns = [pa.array(c) for c in (*at, *(np.nan_to_num(d, nan=np.inf, posinf=np.inf) for d in away))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "i", "j", "away_i", "away_j"])

        kinds = "id long, label long, v array<double>, i long, j long, away_i double, away_j double"
        placed = stage(rows.select("id", "label", "v").mapInArrow(assign, kinds), "cells")
        radii = [np.zeros(size) for size in sizes]
        for code, radius in (("i", radii[0]), ("j", radii[1])):
            for row in placed.groupBy(code).agg(F.max(f"away_{code}").alias("r")).collect():  # a row per code
                radius[row[code]] = row["r"] * (1 + 1e-9)
        counted = np.zeros(sizes, np.int64)
        for row in placed.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per cell
            counted[row["i"], row["j"]] = row["n"]
        self.codes = Codes(halves, radii, counted)
        chunks = [(int(i * sizes[1] + j), int(-(-counted[i, j] // CHUNK_ROWS))) for i, j in zip(*np.nonzero(counted))]
        self.chunks_of = spark.createDataFrame(chunks, "cell long, chunks int")
        cell = (F.col("i") * sizes[1] + F.col("j")).alias("cell")
        dealt = placed.select(cell, "id", "label", "v", F.monotonically_increasing_id().alias("at")).join(F.broadcast(self.chunks_of), "cell")
        # repeated rows are dealt by their place in the written table, equal as they are
        dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("id", "at"), F.col("chunks")).cast("int"))
        self.chunks = stage(dealt.groupBy("cell", "chunk").applyInArrow(_packer(width), f"cell long, chunk int, {PACKED}"), "chunks")


PACKED = "n int, ids binary, labels binary, rows binary"


def _packed(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> dict[str, pa.Array]:
    blobs = {"ids": ids.astype(np.int64), "labels": labels.astype(np.int64), "rows": rows.astype(np.float64)}
    return {"n": pa.array([len(ids)], pa.int32()), **{k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in blobs.items()}}


def _packer(width: int):
    def pack(group: pa.Table) -> pa.Table:
        keys = {c: group[c].slice(0, 1) for c in group.column_names if c in ("cell", "chunk", "block")}
        ids, labels = (group[c].to_numpy() for c in ("id", "label"))
        return pa.table({**keys, **_packed(ids, labels, matrix(group["v"], width))})

    return pack


def _unpacked(row: dict, width: int, scale: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.frombuffer(row[prefix + c], np.int64) for c in ("ids", "labels"))
    return ids, labels, exact.floored(np.frombuffer(row[prefix + "rows"], np.float64).reshape(-1, width), scale)


# ---------------------------------------------------------------- search

HITS = "block long, place int, window int, anchor_id long, id long, score long"


def _asker(codes: Codes, width: int, scale: int, may_see: int):
    """Rows (block, cell) of the cells that the anchors of a block need, and (block, -1) if one of them needs more than it may see.

    ``limits`` of a block has (place, floor): hits of that anchor below the floor are of no use.
    """

    def ask(batches):
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                _, _, x = _unpacked(row, width, scale)
                first, second = codes.bounds(x)
                floor = np.full(row["n"], np.inf)
                for place, low in map(dict.values, row["limits"]):
                    floor[place] = min(floor[place], -np.inf if low is None else float(np.nextafter(float(low), -np.inf)))
                wanted, more = set(), False
                for place in np.flatnonzero(floor < np.inf).tolist():
                    seen = 0
                    for bound, i, j in visits(first[place], second[place]):
                        if bound < floor[place]:
                            break
                        if not codes.held[i, j]:
                            continue
                        if seen >= may_see:
                            more = True
                            break
                        seen += int(codes.held[i, j])
                        wanted.add(i * codes.held.shape[1] + j)
                found += [(row["block"], cell) for cell in sorted(wanted)] + ([(row["block"], -1)] if more else [])
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["block", "cell"])

    return ask


def _reduced(hits: np.ndarray, k: int) -> np.ndarray:
    """The k best rows (block, place, window, anchor, id, score) of each window."""
    hits = hits[np.lexsort((hits[:, 4], -hits[:, 5], hits[:, 2], hits[:, 1], hits[:, 0]))]
    first = np.append(True, (hits[1:, :3] != hits[:-1, :3]).any(1))
    at = np.arange(len(hits))
    return hits[at - np.maximum.accumulate(np.where(first, at, 0)) < k]


def _finder(width: int, scale: int, k: int, same: bool):
    """The k best hits of each anchor and window in the chunks of a task, among rows with the same or with another label.

    Hits of several chunks are reduced together; those of more than HELD_HITS rows go out.
    """

    def batch_of(hits: np.ndarray) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(hits[:, i]).cast(t) for i, t in enumerate(kinds)], [f.split()[0] for f in HITS.split(", ")])

    def find(batches):
        out, n = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                ids, labels, x = _unpacked(row, width, scale)
                own_ids, own_labels, q = _unpacked(row, width, scale, "q_")
                scores = exact.products(q, x)
                for place, window, low, high in map(dict.values, row["windows"]):
                    fits = (ids != own_ids[place]) & ((labels == own_labels[place]) == same)
                    if low is not None:
                        fits &= (scores[place] >= low) & (scores[place] <= high)
                    inside = np.flatnonzero(fits.astype(bool))
                    hits = inside[exact.best(scores[place][inside], ids[inside], k)]
                    if len(hits):
                        found = np.empty((len(hits), 6), np.int64)
                        found[:, :4] = row["block"], place, window, own_ids[place]
                        found[:, 4], found[:, 5] = ids[hits], exact.longs(scores[place][hits])
                        out.append(found)
                        n += len(found)
                if n > HELD_HITS:
                    out = [_reduced(np.concatenate(out), k)]
                    n = len(out[0])
                    if n > HELD_HITS // 2:
                        yield batch_of(out[0])
                        out, n = [], 0
        if out:
            yield batch_of(_reduced(np.concatenate(out), k))

    return find


def search(index: Index, blocks: DataFrame, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """``block, place, window, anchor_id, id, score, rank``: the k best rows of each window, ties to the smaller id.

    ``blocks`` has packed anchors; ``windows`` has ``block, place, window, low, high``, where nulls mean any score. ``same`` asks for rows
    with the anchor's label, otherwise rows with another one. A row with the anchor's id is its own and never found.
    """
    width, scale = index.width, index.scale
    order = Window.partitionBy("block", "place", "window").orderBy(F.desc("score"), "id")
    lists = windows.groupBy("block").agg(F.collect_list(F.struct("place", "window", "low", "high")).alias("windows"))  # a few per anchor
    asking = stage(blocks.join(lists, "block"), "asking")
    hits, seen, may_see = None, None, FIRST_ROWS
    open_blocks = asking
    while True:
        floors = windows.withColumn("floor", F.col("low"))
        if hits is not None:
            last = hits.filter(F.col("rank") == k).select("block", "place", "window", F.col("score").alias("last"))
            floors = windows.join(last, ["block", "place", "window"], "left").withColumn("floor", F.greatest("low", "last"))
        limits = floors.groupBy("block").agg(F.collect_list(F.struct("place", "floor")).alias("limits"))
        asked = open_blocks.join(limits, "block").select("block", "n", "ids", "labels", "rows", "limits")
        asked = stage(asked.mapInArrow(_asker(index.codes, width, scale, may_see), "block long, cell long"), "asked")
        new = asked.filter("cell >= 0")
        new = new if seen is None else new.join(seen, ["block", "cell"], "left_anti")
        new = stage(new, "visits")
        seen = new if seen is None else seen.unionByName(new)
        # a chunk per row, so that a large cell meets its blocks in many tasks
        met = new.join(F.broadcast(index.chunks_of), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        packed = asking.select("block", "windows", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "labels", "rows")])
        # blocks go to the chunks, which are larger and read once per round
        rows = met.join(packed, "block").join(index.chunks, ["cell", "chunk"])
        found = rows.mapInArrow(_finder(width, scale, k, same), HITS)
        if hits is not None:
            found = found.unionByName(hits.drop("rank"))
        hits = stage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "hits")
        left = asked.filter("cell < 0").select("block")
        if not left.limit(1).count():
            return hits
        open_blocks = asking.join(left, "block", "left_semi")
        may_see *= GROWTH


def mine(
    df: DataFrame, key: str, label: str, vector: str, is_anchor: Column, positives: int = 5, negatives: int = 3,
    low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components are floor(scale * x), scores integer inner products. The positives of an anchor are its best other rows with the same label;
    for each, the best rows with another label with low * positive <= 100 * negative <= high * positive follow, ranked from 1. Ties go to the smaller
    id. Rows with a null id, label or vector or a null or non-finite component take no part. Rows with an anchor's id are its own. A
    repeated anchor is answered once, other repeated rows count each. Vectors of other lengths are padded with zeros. Other columns are not
    read; an empty table gives no rows. Components may have any size; a score of the answer that does not fit a long is an error.
    """
    own = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"), is_anchor.alias("asks"))
    rows = stage(own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))), "vectors")
    index = Index(rows, rows.count(), scale)
    anchors = rows.filter("asks").select("id", "label", "v").distinct()
    blocks = max(1, -(-anchors.count() // BLOCK_ROWS))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    packed = stage(dealt.groupBy("block").applyInArrow(_packer(index.width), f"block long, {PACKED}"), "anchors")
    every = packed.select("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
    anything = every.select("block", "place", F.lit(0).alias("window"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    found = search(index, packed, anything, positives, same=True).select(
        "block", "place", F.col("rank").alias("window"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    wide = F.col("positive_score").cast("decimal(20, 0)")
    windows = found.select(
        "block", "place", "window", F.ceil(wide * low / 100).cast("long").alias("low"), F.floor(wide * high / 100).cast("long").alias("high")
    ).filter("low <= high")
    answers = search(index, packed, windows, negatives, same=False).select(
        "block", "place", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    joined = found.join(answers, ["block", "place", "window"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
