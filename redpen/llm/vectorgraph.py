"""Near-duplicate vectors by range search in a robust-pruned flat graph.

Centres fitted on a bounded sample deal all vectors into overlapping shards. Every shard builds a pruned neighbour
graph of its own, and the adjacency lists of a vector are united. Each vector then searches the shards near
it: greedily from the medoid, and on through everything inside a widened range. Each hit is verified by its cosine.
A bounded sample of vectors is audited against brute force, and shards are searched more widely until recall is right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from redpen.llm.batches import lists
from redpen.llm.components import components
from redpen.llm.topk import usable
from redpen.session import stage

LEAST_COSINE = 0.95
SAMPLE_ROWS = 8192  # vectors the centres are fitted on, in the order of a hash
CENTRES = 1024  # at most
SHARD_ROWS = 1024  # a larger shard is split by a hash, and searched in all its parts
OVERLAP = 2  # shards a vector is put in
PROBES = 3  # nearest shards a vector searches at first
DEGREE = 24  # neighbours kept in one shard
CANDIDATES = 48  # nearest vectors considered as neighbours, besides as many others
ALPHA = 1.2  # a neighbour hides what is this much closer to it
BEAM = 16  # best nodes that the greedy search expands
WIDER = 0.05  # nodes this far below the least cosine are expanded as well
AUDITED = 256  # vectors whose links are counted by brute force
RECALL = 0.98


def _matrix(column) -> np.ndarray:
    """A list column as rows of unit length; short rows are padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 1))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1)))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _wide(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, max(0, width - rows.shape[1]))))


def fit_centres(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centres by spherical k-means, from spread-out first choices."""
    chosen = [0]
    near = vectors @ vectors[0]
    while len(chosen) < min(k, len(vectors)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, vectors @ vectors[chosen[-1]])
    centres = vectors[chosen]
    for _ in range(rounds):
        owner = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def _near_shards(centres, n: int):
    def run(batches):
        held = centres.value
        for batch in batches:
            rows = _matrix(batch["v"])
            width = max(rows.shape[1], held.shape[1])
            near = np.argsort(-(_wide(rows, width) @ _wide(held, width).T), axis=1, kind="stable")[:, :n]
            sizes = np.full(len(rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["v"], lists(near.ravel().astype(np.int32), sizes, pa.int32())], ["rep", "v", "near"])

    return run


# ---------------------------------------------------------------- graph of a shard


def robust_prune(similarity: np.ndarray, node: int, candidates: np.ndarray) -> list[int]:
    """Up to DEGREE candidates, nearest first; one that is much closer to a kept neighbour is left to it."""
    order = candidates[np.argsort(-similarity[node, candidates], kind="stable")]
    order = order[order != node]
    kept: list[int] = []
    while len(order) and len(kept) < DEGREE:
        best = order[0]
        kept.append(int(best))
        order = order[1:]
        # distances on the unit sphere
        order = order[ALPHA * np.sqrt(np.maximum(1 - similarity[best, order], 0)) > np.sqrt(np.maximum(1 - similarity[node, order], 0))]
    return kept


def shard_graph(vectors: np.ndarray) -> tuple[list[list[int]], int]:
    """(adjacency lists, medoid) of the vectors of one shard."""
    n = len(vectors)
    similarity = vectors @ vectors.T
    medoid = int(similarity.sum(1).argmax())
    rng = np.random.default_rng(n)
    links: list[set[int]] = []
    for node in range(n):
        nearest = np.argpartition(-similarity[node], min(CANDIDATES, n - 1))[: CANDIDATES + 1]
        others = rng.integers(0, n, CANDIDATES)
        links.append(set(robust_prune(similarity, node, np.unique(np.concatenate([nearest, others, [medoid]])))))
    for node in range(n):  # edges back, so that every node can be reached
        for other in list(links[node]):
            links[other].add(node)
    return [sorted(x) if len(x) <= 2 * DEGREE else robust_prune(similarity, i, np.array(sorted(x))) for i, x in enumerate(links)], medoid


def _build(group: pa.Table) -> pa.Table:
    ids = group["rep"].to_numpy()
    adjacency, medoid = shard_graph(_matrix(group["v"]))
    flat = np.array([j for x in adjacency for j in x], np.int64)
    return pa.table({
        "rep": pa.array(ids), "neighbours": lists(ids[flat], np.array([len(x) for x in adjacency]), pa.int64()),
        "medoid": pa.array(np.arange(len(ids)) == medoid),
    })


def range_search(nodes: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs that the search meets with a cosine of ``least`` or more.

    ``adjacency`` has a row per node, filled up with the node itself; ``entries`` the nodes each query starts from. All queries
    take a step at a time: the best node not expanded yet, as long as it is among the BEAM best or inside the widened range.
    """
    n = len(nodes)
    met = np.full((len(queries), n), -np.inf)
    waiting = np.full((len(queries), n), -np.inf)
    rows = np.arange(len(queries))
    for entry in entries.T:
        met[rows, entry] = waiting[rows, entry] = np.einsum("qd,qd->q", queries, nodes[entry])
    active = rows
    while len(active):
        best = waiting[active].argmax(1)
        value = waiting[active, best]
        kth = np.partition(met[active], n - BEAM, axis=1)[:, n - BEAM] if n > BEAM else np.full(len(active), -np.inf)
        go = (value > -np.inf) & ((value >= kth) | (value >= least - WIDER))
        active, best = active[go], best[go]
        waiting[active, best] = -np.inf
        steps = adjacency[best]
        fresh = np.isneginf(met[active[:, None], steps])
        q, at = np.nonzero(fresh)
        q, node = active[q], steps[q, at]
        met[q, node] = waiting[q, node] = np.einsum("pd,pd->p", queries[q], nodes[node])
    return np.nonzero(met >= least)


HITS = "a long, b long"


def _searcher(least: float):
    def search(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = nodes["rep"].to_numpy(), queries["asked"].to_numpy()
        if not len(ids) or not len(asked):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        order = np.argsort(ids)
        ids = ids[order]
        vectors, wanted = _matrix(nodes["v"])[order], _matrix(queries["wanted"])
        width = max(vectors.shape[1], wanted.shape[1])
        vectors, wanted = _wide(vectors, width), _wide(wanted, width)
        column = nodes["neighbours"].combine_chunks()
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        inside = ids[place] == flat  # united lists also lead to other shards
        adjacency = np.repeat(np.arange(len(ids))[:, None], max(int(sizes.max(initial=0)), 1), 1)
        owner = np.repeat(np.argsort(order), sizes)
        slot = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        adjacency[owner[inside], slot[inside]] = place[inside]
        medoids = np.flatnonzero(nodes["medoid"].to_numpy()[order])
        medoid = medoids[0] if len(medoids) else 0
        own = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        entries = np.stack([np.full(len(asked), medoid), np.where(ids[own] == asked, own, medoid)], 1)
        q, node = range_search(vectors, adjacency, entries, wanted, least)
        other = ids[node] != asked[q]
        a, b = asked[q[other]], ids[node[other]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return search


# ---------------------------------------------------------------- operator


def distinct_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(all rows as ``id, same`` (null when they link with nothing), one row per distinct vector as ``same, rep, held, v``)."""
    own = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & usable(F.col("v")) & F.exists("v", lambda x: x != 0)
    own = own.select("id", F.when(fine, F.col("v")).alias("v"))
    own = own.withColumn("same", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("x"), F.xxhash64(F.lit(1), "v").alias("y"))))
    classes = own.filter("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("held"), F.any_value("v").alias("v"))
    return own.select("id", "same"), classes


def sharded(vectors: DataFrame, n: int) -> DataFrame:
    """``rep, v, near``: the nearest centres of each vector, nearest first."""
    sample = vectors.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).toArrow()
    rows = _matrix(sample["v"]) if sample.num_rows else np.zeros((1, 1))
    centres = fit_centres(rows, int(min(CENTRES, max(1, -(-n // SHARD_ROWS)))))
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    return vectors.select("rep", "v").mapInArrow(_near_shards(held, len(centres)), "rep long, v array<double>, near array<int>")


def search_links(near: DataFrame, graph: DataFrame, parts: DataFrame, probes: int, least: float) -> DataFrame:
    """Verified links ``a < b`` from a search of every vector in its nearest shards.

    Parts of a shard meet the vectors that search it in blocks of about SHARD_ROWS, so a group is bounded
    however many vectors lie in one place.
    """
    shard_part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    members = near.select("rep", "v", F.explode(F.slice("near", 1, OVERLAP)).alias("shard")).join(parts, "shard")
    nodes = members.join(graph, "rep").withColumn("part", shard_part)
    asked = near.select("rep", "v", F.explode(F.slice("near", 1, probes)).alias("shard")).join(parts, "shard")
    load = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("blocks"))
    asked = asked.join(load, "shard").select(
        F.col("rep").alias("asked"), F.col("v").alias("wanted"), F.col("shard").alias("shard"), F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    nodes = nodes.join(load, "shard").select("rep", "v", "neighbours", "medoid", "shard", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    keys = ["shard", "part", "block"]
    return nodes.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_searcher(least), HITS).distinct()


def _brute(sample, least: float):
    def run(batches):
        ids, rows = sample.value
        for batch in batches:
            vectors, own = _matrix(batch["v"]), batch["rep"].to_numpy()
            width = max(vectors.shape[1], rows.shape[1])
            i, j = np.nonzero(_wide(rows, width) @ _wide(vectors, width).T >= least)
            other = ids[i] != own[j]
            a, b = ids[i[other]], own[j[other]]
            yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def true_links(vectors: DataFrame, least: float, rows: int = AUDITED) -> DataFrame:
    """All links of a sample of at most ``rows`` vectors, by brute force."""
    sample = vectors.select("rep", "v").orderBy(F.xxhash64("rep", F.lit("audit")), "rep").limit(rows).toArrow()
    held = vectors.sparkSession.sparkContext.broadcast((sample["rep"].to_numpy(), _matrix(sample["v"])))
    return vectors.select("rep", "v").mapInArrow(_brute(held, least), HITS).distinct()


def build_graph(vectors: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nearest shards of the vectors, united adjacency lists ``rep, neighbours, medoid``, parts of the shards)."""
    near = stage(sharded(vectors, n), "near-shards")
    members = near.select("rep", "v", F.explode(F.slice("near", 1, OVERLAP)).alias("shard"))
    parts = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / (2 * SHARD_ROWS)).cast("int").alias("parts"))
    placed = members.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    graphs = placed.groupBy("shard", "part").applyInArrow(_build, "rep long, neighbours array<long>, medoid boolean")
    united = graphs.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"), F.max("medoid").alias("medoid"))
    return near, stage(united, "graph"), stage(parts, "parts")


def near_vectors(df: DataFrame, key: str, vector: str, least: float = LEAST_COSINE) -> DataFrame:
    """``key, n_links, component_id, kept``: one row per input row.

    ``n_links`` counts the other rows with a cosine of ``least`` or more that the search finds; ``component_id`` is the
    smallest id reachable. Vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows without an id,
    which have no component and are kept. Equal vectors are one node with its number of rows. Vectors of
    different lengths are compared as if padded with zeros. An empty table gives no rows. Other columns are not read.
    """
    rows, classes = distinct_vectors(df, key, vector)
    rows, classes = stage(rows, "vector-rows"), stage(classes, "vectors")
    n = classes.count()
    near, graph, parts = build_graph(classes, n)
    truth = stage(true_links(classes, least), "audit")
    wanted, probes = truth.count(), PROBES
    while True:
        links = stage(search_links(near, graph, parts, probes, least), "links")
        if probes >= CENTRES or truth.join(links, ["a", "b"], "left_semi").count() >= RECALL * wanted:
            break
        probes *= 2
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    counted = ends.join(classes.select(F.col("rep").alias("other"), "held"), "other").groupBy("rep").agg(F.sum("held").alias("linked"))
    labels = components(links).select(F.col("node").alias("rep"), "component")
    of_class = classes.select("same", "rep", "held").join(counted, "rep", "left").join(labels, "rep", "left").select(
        "same", (F.col("held") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    found = rows.join(of_class, "same", "left")
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("id").isNull() | (component == F.col("id"))).alias("kept"),
    )
