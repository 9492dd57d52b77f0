"""The prefix trie of conversations, with subtree counts from balanced parentheses.

Every turn gets the hash of the sequence up to it, a running sum of hashes of place and turn, so equal sequences are equal nodes
wherever they lie. Members, children and parents of nodes are groupings and joins by that hash.

Counts over subtrees need an order in which a subtree is one stretch. Nodes with the same members form a chain and are one edge of the
compressed trie, named by its smallest member and its number of members. The edges that a conversation passes are its path; paths are
sorted into shards, and each shard writes its trie as balanced parentheses: findclose (by blocks with their smallest and largest excess) ends
a subtree, the rank of leaf pairs counts leaves, and cumulative arrays give savings. Edges on the first or last
path of a shard may go on in other shards; these spines are merged. A path has no more edges than the square root of twice
the number of turns, because each needs a conversation of its own that ends there.

Running sums go over sorted ranges of any conversation: a long one lies in many tasks, and only one carry per task goes through the driver.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from redpen.session import stage

HEAVY = 1 << 16  # rows that meet one row of a join from which on that row is broadcast; there are at most rows / HEAVY of them
CHUNK = 8192  # ids that are written out together
BLOCK = 512  # parentheses in a block
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# ---------------------------------------------------------------- running sums


def _local_sums(conv: str, values: list[str], totals: bool):
    def run(batches):
        held, n, sums = None, 0, [np.uint64(0)] * len(values)
        if totals:  # ids and numbers of one partition
            batches = [b for b in batches if b.num_rows]
            batches = pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch[conv].to_numpy()
            first = np.append(True, ids[1:] != ids[:-1])
            starts, of = np.flatnonzero(first), np.cumsum(first) - 1
            same = of == 0 if ids[0] == held else np.zeros(len(ids), bool)
            at = np.arange(1, len(ids) + 1) - starts[of] + np.where(same, n, 0)
            out = []
            for k, name in enumerate(values):
                own = batch[name].to_numpy().astype(np.int64).view(np.uint64)
                upto = np.cumsum(own, dtype=np.uint64)
                upto = upto - (upto[starts] - own[starts])[of]
                upto[same] += sums[k]
                out.append(upto)
            held, n, sums = ids[-1], int(at[-1]), [x[-1] for x in out]
            last = np.append(starts[1:], len(ids)) - 1
            whole = [x[last][of] for x in out] if totals else []
            columns = [*batch.columns, pa.array(at), *[pa.array(x.view(np.int64)) for x in out + whole]]
            done = pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_at", *[f"run_{v}" for v in values], *[f"all_{v}" for v in values if totals]])
            for low in range(0, done.num_rows, 1 << 16):
                yield done.slice(low, 1 << 16)

    return run


def running(rows: DataFrame, conv: str, order: list[str], values: list[str], totals: bool = False) -> DataFrame:
    """Add ``run_<value>``, the sum (modulo 2**64) up to the row in its conversation, and with ``totals`` ``all_<value>``, that of the whole one.

    Rows are sorted in ranges of (conv, order), so a long conversation lies in many tasks; ``order`` has to be unique in it. With ``totals`` a task holds
    the ids and numbers of its range.
    """
    spark = rows.sparkSession
    runs, wholes = [f"run_{v}" for v in values], [f"all_{v}" for v in values if totals]
    ordered = rows.repartitionByRange(conv, *order).sortWithinPartitions(conv, *order).withColumn("_part", F.spark_partition_id())
    fields = ", ".join([*(f"`{c}` {t}" for c, t in ordered.dtypes), "_at long", *(f"{c} long" for c in runs + wholes)])
    local = stage(ordered.mapInArrow(_local_sums(conv, values, totals), fields), "runs")
    ends = local.groupBy("_part").agg(
        F.min(F.struct(conv, (-F.col("_at")).alias("a"), *runs)).alias("first"), F.max(F.struct(conv, F.col("_at").alias("a"), *runs)).alias("last")
    )
    offsets, crossing, carried = {}, {}, (None, ())
    mask = (1 << 64) - 1
    for row in sorted(ends.collect()):  # one row per task
        first, last = row["first"], row["last"]
        sums = [first[r] & mask for r in runs]
        if first[conv] == carried[0]:
            offsets[row["_part"]] = (first[conv], carried[1])
            sums = [(a + b) & mask for a, b in zip(sums, carried[1])]
            crossing[first[conv]] = sums
        carried = (last[conv], sums if first[conv] == last[conv] else [last[r] & mask for r in runs])
    clean = [c for c in local.columns if c not in ("_part", "_at")]
    if not offsets:
        return local.select(*clean)
    held = spark.sparkContext.broadcast((offsets, crossing))

    def carry(batches):
        offsets, crossing = held.value
        for batch in batches:
            ids, part = batch[conv].to_numpy(), batch["_part"].to_numpy()
            columns = {c: batch[c] for c in batch.schema.names}
            new = {c: batch[c].to_numpy().view(np.uint64).copy() for c in runs + wholes}
            for p in np.unique(part).tolist():
                if p in offsets:
                    hit = (part == p) & (ids == offsets[p][0])
                    for name, more in zip(runs, offsets[p][1]):
                        new[name][hit] += np.uint64(more)
            if wholes:
                for one in np.unique(ids[np.isin(ids, list(crossing))]).tolist():
                    for name, total in zip(wholes, crossing[one]):
                        new[name][ids == one] = np.uint64(total)
            columns |= {c: pa.array(x.view(np.int64)) for c, x in new.items()}
            yield pa.RecordBatch.from_pydict(columns)

    return local.mapInArrow(carry, local.schema).select(*clean)


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, pos, role, text``: turns numbered from 1, null turns first, equal turns by role and text; null role or text is empty.

    Rows without a conversation id are left out. ``rows`` is read from files, so that repeated rows keep the order in which they lie there.
    """
    own = rows.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(1).cast("long").alias("pos"), F.monotonically_increasing_id().alias("copy"),
    ).filter("conv is not null")
    return running(own, "conv", ["turn", "role", "text", "copy"], ["pos"]).select("conv", F.col("run_pos").alias("pos"), "role", "text")


def weighted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """Join with unique rows of ``right`` that know how many rows of ``left`` they meet.

    Those that meet HEAVY rows or more are broadcast, so no shuffled key is larger than that.
    """
    heavy, light = right.filter(F.col(weight) >= HEAVY).drop(weight), right.filter(F.col(weight) < HEAVY).drop(weight)
    of_heavy = left.join(F.broadcast(heavy), keys)
    return of_heavy.unionByName(left.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, how))


# ---------------------------------------------------------------- balanced parentheses


class Parentheses:
    """A sequence of opening (True) and closing brackets with the smallest and largest excess of each block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1))
        edges = np.arange(0, len(bits), BLOCK)
        self.low, self.high = np.minimum.reduceat(self.excess, edges), np.maximum.reduceat(self.excess, edges)
        self.opened = np.cumsum(bits)  # rank of opening brackets
        pair = np.append(bits[:-1] & ~bits[1:], False)
        self.pairs = np.cumsum(pair)  # rank of leaf pairs

    def findclose(self, i: int) -> int:
        target = self.excess[i] - 1
        end = (i // BLOCK + 1) * BLOCK
        hit = np.flatnonzero(self.excess[i + 1 : end] == target)
        if len(hit):
            return i + 1 + int(hit[0])
        block = i // BLOCK + 1
        block += int(np.argmax((self.low[block:] <= target) & (self.high[block:] >= target)))
        return block * BLOCK + int(np.flatnonzero(self.excess[block * BLOCK : (block + 1) * BLOCK] == target)[0])


class Trie:
    """The trie of sorted paths (tuples of edges, the first one common to all) as parentheses."""

    def __init__(self, paths: list[tuple]):
        bits, self.edges, self.paths, held = [], [], [], ()
        for path in paths:
            common = 0
            while common < min(len(held), len(path)) and held[common] == path[common]:
                common += 1
            bits += [False] * (len(held) - common) + [True] * (len(path) - common)
            self.edges += path[common:]
            self.paths += [path[: i + 1] for i in range(common, len(path))]
            held = path
        self.tree = Parentheses(np.array(bits + [False] * len(held), bool))

    def sums(self, value: np.ndarray, falsely: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf pairs in the subtree, values below the edge) for each edge in opening order.

        ``falsely`` marks edges that are no leaves although nothing follows them here.
        """
        tree = self.tree
        opens = np.flatnonzero(tree.bits)
        closes = np.fromiter((tree.findclose(i) for i in opens.tolist()), np.int64, len(opens))
        at, upto = np.arange(len(opens)), tree.opened[closes]
        lone = closes == opens + 1
        wrong = np.append(0, np.cumsum(lone & falsely))
        leaves = tree.pairs[closes] - tree.pairs[opens] + lone - (wrong[upto] - wrong[at])
        held = np.append(0, np.cumsum(value))
        return leaves, held[upto] - held[at + 1]


EDGE = "struct<pos: long, first: long, members: long, worth: long, tail: boolean>"
SUMS = f"first long, members long, leaves long, below long, worth long, path array<{EDGE}>"


def _shard(batches):
    """Sums of the edges of one range of paths; edges on its first and last path keep their path and leave their own worth out."""
    rows = [tuple(tuple(e.values()) for e in path) for batch in batches for path in batch["path"].to_pylist()]
    if not rows:
        return
    trie = Trie(rows)
    spine = set(rows[0]) | set(rows[-1])
    tail = np.array([e[4] for e in trie.edges])
    open_ = np.array([e in spine and not e[4] for e in trie.edges])
    worth = np.array([e[3] for e in trie.edges], np.int64)
    leaves, below = trie.sums(np.where(open_, 0, worth), ~tail)
    keep = np.flatnonzero(~tail).tolist()
    kind = pa.list_(pa.struct([("pos", pa.int64()), ("first", pa.int64()), ("members", pa.int64()), ("worth", pa.int64()), ("tail", pa.bool_())]))
    for at in range(0, len(keep), 4096):
        some = keep[at : at + 4096]
        paths = [[dict(zip(("pos", "first", "members", "worth", "tail"), e)) for e in trie.paths[i]] if open_[i] else None for i in some]
        columns = [pa.array([trie.edges[i][k] for i in some], pa.int64()) for k in (1, 2)]
        columns += [pa.array(x[some], pa.int64()) for x in (leaves, below, worth)] + [pa.array(paths, kind)]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ("first", "members", "leaves", "below", "worth", "path")])


def _merged(group: pa.Table) -> pa.Table:
    """Spine edges of all shards: what lies below each, their own worths included."""
    rows = group.to_pylist()
    full = [tuple(tuple(e.values()) for e in r["path"]) for r in rows]
    order = sorted(range(len(rows)), key=full.__getitem__)
    trie = Trie([full[i] for i in order])
    assert len(trie.edges) == len(rows)  # the prefixes of a spine are spine
    _, more = trie.sums(np.array([rows[i]["worth"] for i in order], np.int64), np.zeros(len(rows), bool))
    picked = group.take(order).select(["first", "members", "leaves"])
    return picked.append_column("below", pa.array(np.array([rows[i]["below"] for i in order], np.int64) + more))


def subtree_sums(paths: DataFrame) -> DataFrame:
    """``first, members, leaves, below`` for the inner edges of the distinct ``path``s."""
    sorted_ = paths.repartitionByRange("path").sortWithinPartitions("path")
    sums = stage(sorted_.mapInArrow(_shard, SUMS), "subtrees")
    spine = sums.filter("path is not null").groupBy("first", "members").agg(
        F.sum("leaves").alias("leaves"), F.sum("below").alias("below"), F.first("worth").alias("worth"), F.first("path").alias("path")
    )
    # two paths per shard, whatever the number of conversations
    merged = spine.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_merged, "first long, members long, leaves long, below long")
    return sums.filter("path is null").select("first", "members", "leaves", "below").unionByName(merged)


# ---------------------------------------------------------------- lists of ids


def _chunks(batches):
    """Rows sorted by node and id: ids joined by commas, CHUNK at a time."""
    for batch in batches:
        for low in range(0, batch.num_rows, CHUNK):
            part = batch.slice(low, CHUNK)
            keys = [part[c].to_numpy() for c in ("pos", "a", "b")]
            ids = part["conv"].to_numpy()
            first = np.append(True, reduce(np.logical_or, [k[1:] != k[:-1] for k in keys]))
            starts = np.flatnonzero(first)
            text = [",".join(map(str, x)) for x in np.split(ids, starts[1:])]
            columns = [*[pa.array(k[starts]) for k in keys], pa.array(ids[starts]), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "a", "b", "least", "text"])


def _digests(batches):
    """Rows sorted by node and first id: one digest per node, fed piece by piece."""
    node, digest = None, None
    for batch in batches:
        found = []
        for *key, text in zip(*(batch[c].to_pylist() for c in ("pos", "a", "b", "text"))):
            if key == node:
                digest.update(b",")
            else:
                if node:
                    found.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256()
            digest.update(text.encode())
        yield _digest_rows(found)
    if node:
        yield _digest_rows([(*node, digest.hexdigest())])


def _digest_rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], ["pos", "a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``pos, a, b, ends_sha256``: the hash of the ascending ids of each node, joined by commas.

    Ids of one node are sorted and joined in many tasks; one task then only reads the joined texts of a node as a stream.
    """
    ordered = ends.select("pos", "a", "b", "conv").repartitionByRange("pos", "a", "b", "conv").sortWithinPartitions("pos", "a", "b", "conv")
    joined = ordered.mapInArrow(_chunks, "pos long, a long, b long, least long, text string")
    return joined.repartition("pos", "a", "b").sortWithinPartitions("pos", "a", "b", "least").mapInArrow(_digests, "pos long, a long, b long, ends_sha256 string")


# ---------------------------------------------------------------- the trie


def _hash(seed: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def prefix_trie(turns: DataFrame, conv: str, order: list[str], role: str, text: str, members: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_bytes, ends_sha256``: one row per distinct prefix.

    ``turns`` are ordered by ``order``, unique in a conversation; ``members`` has all conversation ids in ``conv``, once each, with or without turns. A node is a distinct
    sequence of first turns (role and text; null is empty); its name is its smallest member and its depth. The root has no parent. ``n_leaves`` counts
    the childless nodes of the subtree, ``saved_bytes`` sums (members - 1) times the bytes of the last text over it, ``ends_sha256`` hashes the ids that end
    there. Without members there are no nodes. Rows with a null id take no part; other columns are not read.
    """
    none = F.lit(0).cast("long")
    plain = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    own = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.struct(*order).alias("o"), F.lit(1).cast("long").alias("pos"),
        _hash(1, *plain).alias("x"), _hash(2, *plain).alias("y"), F.octet_length(plain[1]).cast("long").alias("bytes"),
    )
    roots = members.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.lit(None).cast(own.schema["o"].dataType).alias("o"), none.alias("pos"), none.alias("x"), none.alias("y"), none.alias("bytes")
    )
    placed = running(own.unionByName(roots), "conv", ["o"], ["pos"]).select("conv", F.col("run_pos").alias("pos"), "x", "y", "bytes")
    root = F.col("pos") == 0
    marked = placed.withColumns({s: F.when(root, none).otherwise(_hash(i, F.col("pos"), F.col("x"), F.col("y"))) for i, s in ((3, "g"), (4, "k"))})
    # the sum of no places is the root, and the sum without the last place is the parent
    rows = running(marked.select("conv", "pos", "g", "k", "bytes", (~root).cast("long").alias("one")), "conv", ["pos"], ["g", "k", "bytes", "one"], totals=True)
    rows = rows.select(
        "conv", "pos", F.col("run_g").alias("a"), F.col("run_k").alias("b"), "g", "k", "bytes",
        F.col("run_bytes").alias("upto"), F.col("all_one").alias("length"), F.col("all_g").alias("end_a"), F.col("all_k").alias("end_b"),
    )
    rows = stage(rows, "turns")
    node = ["pos", "a", "b"]
    end = F.struct("length", "end_a", "end_b")
    nodes = rows.groupBy(*node).agg(
        F.count(F.lit(1)).alias("members"), F.min("conv").alias("first"), F.min("g").alias("g"), F.min("k").alias("k"), F.min("bytes").alias("bytes"),
        F.min("upto").alias("upto"), F.min(end).alias("low"), F.max(end).alias("high"), F.count_if(F.col("pos") == F.col("length")).alias("ending"),
    )
    # a parent is the node without the last place; sums are modulo 2**64, so wider numbers are folded back
    nodes = stage(nodes.withColumns({"pa": _less("a", "g"), "pb": _less("b", "k")}).drop("g", "k"), "nodes")
    children = nodes.filter("pos > 0").groupBy((F.col("pos") - 1).alias("pos"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, node, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = stage(nodes.withColumn("tail", F.col("low") == F.col("high")), "nodes")
    forks = F.col("n_children") + F.when(F.col("ending") > 0, 1).otherwise(0) > 1
    parents = nodes.filter("n_children > 0").select(
        (F.col("pos") + 1).alias("pos"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("first").alias("parent"), forks.alias("top"), "n_children"
    )
    named = weighted_join(nodes.filter("pos > 0"), parents.withColumnRenamed("n_children", "_meets"), ["pos", "pa", "pb"], "_meets")
    at_root = nodes.filter("pos = 0").withColumns({"parent": F.lit(None).cast("long"), "top": F.lit(True)})
    named = stage(named.unionByName(at_root), "nodes")
    edge = ["first", "members"]
    edges = stage(named.groupBy(*edge).agg(
        F.sum("bytes").alias("chain"), F.max("upto").alias("bottom"), F.count(F.lit(1)).alias("held"), F.min("pos").alias("pos")), "edges")
    tops = named.filter("top").select(*node, *edge, "tail").join(edges.select(*edge, "chain"), edge)
    tops = tops.select(*node, F.struct(
        "pos", "first", "members", ((F.col("members") - 1) * F.col("chain")).alias("worth"), "tail").alias("edge"), "members")
    passed = weighted_join(rows.select("conv", *node), tops.withColumnRenamed("members", "_meets"), node, "_meets")
    paths = passed.groupBy("conv").agg(F.sort_array(F.collect_list("edge")).alias("path")).select("path").distinct()
    sums = edges.select(*edge, "bottom", "held").join(subtree_sums(paths), edge, "left")
    summed = weighted_join(named, sums, edge, "held", "left")
    digests = end_digests(rows.filter("pos = length"))
    below = F.coalesce("below", F.lit(0))
    return summed.join(digests, node, "left").select(
        F.col("first").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"),
        "n_children", F.when(F.col("tail"), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
        (below + (F.col("members") - 1) * (F.col("bottom") - F.col("upto") + F.col("bytes"))).alias("saved_bytes"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )


def _less(total: str, last: str) -> Column:
    """The difference of two longs modulo 2**64."""
    wide = F.col(total).cast("decimal(20, 0)") - F.col(last).cast("decimal(20, 0)")
    turn, half = (F.lit(str(1 << n)).cast("decimal(20, 0)") for n in (64, 63))
    return F.when(wide >= half, wide - turn).when(wide < -half, wide + turn).otherwise(wide).cast("long")
