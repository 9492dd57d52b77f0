"""Exact top-k search: inner products summed dimension block by dimension block.

Vectors lie in vertical blocks (one row per dimension). After each block of dimensions a
candidate keeps its partial score; what the rest can still add is at most the product of
the two remaining norms. Candidates that cannot reach the k-th best any more are compacted
away before the next dimensions are touched, so the answer is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.llm import exact

CHUNK_ROWS = 8192  # candidates in a vertical block
QUERY_ROWS = 256  # queries that meet a block together
DIMENSIONS = 8  # dimensions summed between two prunings
LARGEST = 2.0**28  # scaled components beyond it are kept as doubles and multiplied in wider arithmetic

PACKED = "chunk long, wide boolean, n int, width int, ids binary, cells binary"
FOUND = "query_id long, query_row long, vec_id long, score long"


def usable(vector: Column) -> Column:
    """True for vectors without null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, wide, cells, v`` of every usable vector: floor(scale * x) as ``cells``, or the vector itself where a component is wide.

    Rows with a null id are left out.
    """
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    own = own.filter(F.col("id").isNotNull() & usable(F.col("v")))
    own = own.withColumn("wide", F.exists("v", lambda x: F.abs(x) >= LARGEST / scale))
    cells = F.when(~F.col("wide"), F.transform("v", lambda x: F.when(F.abs(x) < LARGEST / scale, F.floor(x * float(scale)).cast("int"))))
    return own.select("id", "wide", cells.alias("cells"), F.when(F.col("wide"), F.col("v")).alias("v"))


def _matrix(column: pa.ChunkedArray, kind=np.int32) -> np.ndarray:
    """Rows of lists as one matrix, short rows padded with zeros."""
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), kind)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _pack(group: pa.Table) -> pa.Table:
    """One group of vectors as one row that holds its dimensions one after the other."""
    ids, wide = group["id"].to_numpy().astype(np.int64), group["wide"][0].as_py()
    cells = np.ascontiguousarray((_matrix(group["v"], np.float64) if wide else _matrix(group["cells"])).T)
    return pa.table({
        "chunk": pa.array([group["chunk"][0].as_py()], pa.int64()),
        "wide": pa.array([wide], pa.bool_()),
        "n": pa.array([len(ids)], pa.int32()),
        "width": pa.array([cells.shape[0]], pa.int32()),
        "ids": pa.array([ids.tobytes()], pa.binary()),
        "cells": pa.array([cells.tobytes()], pa.binary()),
    })


def packed(vectors: DataFrame, rows: int, total: int, wide: int) -> tuple[DataFrame, int]:
    """(vertical blocks of about ``rows`` vectors, their number), dealt by a hash of id and components; wide vectors have blocks of their own."""
    narrow_blocks, wide_blocks = max(1, -(-(total - wide) // rows)), -(-wide // rows)
    chunk = F.pmod(F.xxhash64("id", "cells"), F.lit(narrow_blocks))
    if wide:
        chunk = F.when(F.col("wide"), narrow_blocks + F.pmod(F.xxhash64("id", "v"), F.lit(wide_blocks))).otherwise(chunk)
    return vectors.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(_pack, PACKED), narrow_blocks + wide_blocks


def _unpacked(n: int, width: int, ids: bytes, cells: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(cells, np.float64 if wide else np.int32).reshape(width, n)


def _suffix_norms(cells: np.ndarray, steps: list[int]) -> np.ndarray:
    """For each step, the norm of the dimensions from there on, a little too large."""
    squares = np.square(cells.astype(np.float64))
    return np.stack([np.sqrt(squares[at:].sum(0)) * (1 + 1e-9) for at in steps])


def best_of_block(query: np.ndarray, cells: np.ndarray, rest_q: np.ndarray, rest_x: np.ndarray, ids: np.ndarray, k: int):
    """(ids, scores) of the k highest integer inner products in the block, ties to the smaller id.

    ``cells`` is vertical; ``rest_q`` and ``rest_x`` bound the dimensions from each step on.
    """
    width = cells.shape[0]
    alive = np.arange(cells.shape[1])
    partial = np.zeros(len(alive), cells.dtype)
    for step, at in enumerate(range(0, width, DIMENSIONS)):
        upto = min(at + DIMENSIONS, width)
        part = cells[at:upto] if len(alive) == cells.shape[1] else cells[at:upto, alive]
        partial = partial + query[at:upto] @ part
        if upto == width or len(alive) <= k:
            continue
        slack = rest_q[step + 1] * rest_x[step + 1][alive] + 1.0
        floor = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
        keep = partial + slack >= floor
        alive, partial = alive[keep], partial[keep]
    scores = partial.astype(np.int64)
    if len(alive) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        inside = scores >= edge
        alive, scores = alive[inside], scores[inside]
    order = np.lexsort((ids[alive], -scores))[:k]
    return ids[alive][order], scores[order]


def _best_wide(ids, cells, wide, query_ids, queries, q_wide, scale: int, k: int):
    """(query number, ids, scores) where whole numbers may be too wide for the block search."""
    x, q = (exact.floored(c.T, scale) if w else c.T.astype(np.float64) for c, w in ((cells, wide), (queries, q_wide)))
    scores = exact.products(q, x)
    for i, own in enumerate(query_ids):
        others = np.flatnonzero(ids != own)
        hits = others[exact.best(scores[i][others], ids[others], k)]
        yield i, ids[hits], exact.longs(scores[i][hits])


def _best_narrow(ids, cells, query_ids, queries, k: int):
    width = len(cells)
    reach = float(np.abs(cells, dtype=np.float64).max(initial=0)) * float(np.abs(queries, dtype=np.float64).max(initial=0))
    kind = np.float64 if reach * max(width, 1) < 2.0**52 else np.int64  # both exact in their range
    cells, queries = cells.astype(kind), np.ascontiguousarray(queries.T).astype(kind)
    steps = list(range(0, max(width, 1), DIMENSIONS))
    rest_x, rest_q = _suffix_norms(cells, steps), _suffix_norms(queries.T, steps)
    for i, own in enumerate(query_ids):
        others = np.flatnonzero(ids != own)
        whole = len(others) == len(ids)
        yield i, *best_of_block(
            queries[i], cells if whole else cells[:, others], rest_q[:, i],
            rest_x if whole else rest_x[:, others], ids if whole else ids[others], k,
        )


def _searcher(k: int, scale: int):
    def search(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                ids, cells = _unpacked(row["n"], row["width"], row["ids"], row["cells"], row["wide"])
                query_ids, queries = _unpacked(row["q_n"], row["q_width"], row["q_ids"], row["q_cells"], row["q_wide"])
                width = max(len(cells), len(queries))
                cells = np.pad(cells, ((0, width - len(cells)), (0, 0)))
                queries = np.pad(queries, ((0, width - len(queries)), (0, 0)))
                # narrow scores stay below 2**63 for as many dimensions as that
                if row["wide"] or row["q_wide"] or width >= 1 << 7:
                    hits = _best_wide(ids, cells, row["wide"], query_ids, queries, row["q_wide"], scale, k)
                else:
                    hits = _best_narrow(ids, cells, query_ids, queries, k)
                found = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
                for i, got, scores in hits:
                    found["query_id"].append(np.full(len(got), query_ids[i]))
                    found["query_row"].append(np.full(len(got), (row["q_chunk"] << 24) + i))
                    found["vec_id"].append(got)
                    found["score"].append(scores)
                columns = {c: pa.array(np.concatenate(v).astype(np.int64)) for c, v in found.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return search


def top_k(df: DataFrame, key: str, vector: str, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """The k rows with the highest integer inner product for each query row.

    ``query_id, rank, vec_id, score``; components are floor(scale * x). Ties go to the
    smaller id. Vectors that are null or hold null or non-finite components and rows without an id take no part.
    Components may have any size: scores are exact, and one of the answer that does not fit a long is an error. Rows that carry the
    query's id are its own row and no candidates; other repeated rows count each. A repeated query row is
    answered once, and an id with several vectors once per vector. Vectors of other lengths
    are padded with zeros; an empty table gives no rows. Other columns are not read.

    Each block of queries meets each block of candidates once; a task holds one such pair.
    """
    vectors = integer_vectors(df, key, vector, scale)
    asked = integer_vectors(df.filter(is_query), key, vector, scale).distinct()
    held = vectors.agg(F.count(F.lit(1)), F.count_if("wide")).first()
    wanted = asked.agg(F.count(F.lit(1)), F.count_if("wide")).first()
    candidates, blocks = packed(vectors, CHUNK_ROWS, *held)
    queries = packed(asked, QUERY_ROWS, *wanted)[0].select(
        *[F.col(c).alias(f"q_{c}") for c in ("chunk", "wide", "n", "width", "ids", "cells")],
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("chunk"),
    )
    found = candidates.join(queries, "chunk").mapInArrow(_searcher(k, scale), FOUND)
    # the best of each task are picked before the shuffle
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
