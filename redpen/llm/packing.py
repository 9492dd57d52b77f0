"""Online packing of token ids into windows by the sum-of-squares rule.

A document is cut into whole windows and a rest. The rest goes, as it comes, to the open window for which the sum of
the squared numbers of windows at each fill level is smallest afterwards; a level array holds these numbers. Windows
close when they are full. What is still open when a task ends (or when too many are open at once) is settled: pieces of the emptiest
windows are cut to fill the others, so at most one window of a task stays open. These last windows meet again, many
tasks at a time, and what then is left is cut into lengths that are powers of two, which need no padding.

Texts are encoded and packed where they lie; only the last open window of each task moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from redpen.llm.batches import parts
from redpen.llm.encoding import WordEncoder
from redpen.session import staged_path

WINDOW = 2048
OPEN_WINDOWS = 4096  # windows that a task holds open; beyond it they are settled
TOGETHER = 1024  # tasks whose last open windows meet in one place

# ---------------------------------------------------------------- windows

Piece = tuple[int | None, int, int, np.ndarray]  # document, its ids before the piece, all its ids, the ids of the piece


class Packer:
    """Places pieces of at most ``size`` ids; full windows come out as lists of pieces."""

    def __init__(self, size: int = WINDOW, most_open: int = OPEN_WINDOWS):
        self.size, self.most_open = size, most_open
        self.at_level: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.n_open = 0
        # what the sum of squares changes by when a window leaves a level or arrives at it
        self.none = 1 << 60
        self.leave = np.full(size, self.none, np.int64)
        self.arrive = np.ones(size + 1, np.int64)
        self.leave[0] = self.arrive[size] = 0

    def _count(self, level: int) -> None:
        n = len(self.at_level[level])
        self.leave[level] = 1 - 2 * n if n else self.none
        self.arrive[level] = 2 * n + 1

    def level_for(self, n: int) -> int:
        """The fill level (0: a new window) that makes the sum of squares smallest; of equal ones the fullest."""
        cost = self.leave[: self.size - n + 1] + self.arrive[n:]
        return len(cost) - 1 - int(cost[::-1].argmin())

    def add(self, piece: Piece) -> list[list[Piece]]:
        """The windows that are full now."""
        n = len(piece[3])
        level = self.level_for(n)
        window = []
        if level:
            window = self.at_level[level].pop()
            self._count(level)
            self.n_open -= 1
        window.append(piece)
        if level + n == self.size:
            return [window]
        self._open(window, level + n)
        return self.settle() if self.n_open > self.most_open else []

    def _open(self, window: list[Piece], level: int) -> None:
        self.at_level[level].append(window)
        self._count(level)
        self.n_open += 1

    def settle(self) -> list[list[Piece]]:
        """Fill the open windows, the fullest first, with what is cut from the emptiest; at most one stays open."""
        waiting = [(level, window) for level in range(1, self.size) for window in self.at_level[level]]  # emptiest first
        for level in {level for level, _ in waiting}:
            self.at_level[level] = []
            self._count(level)
        self.n_open = 0
        full, low, high = [], 0, len(waiting) - 1
        donor: list[Piece] = []
        while low <= high or donor:
            if low > high:
                level, window = 0, []
            else:
                level, window = waiting[high]
                high -= 1
            while level < self.size:
                if not donor:
                    if low > high:
                        break
                    donor = waiting[low][1]
                    low += 1
                doc, start, of, ids = donor.pop()
                room = self.size - level
                window.append((doc, start, of, ids[:room]))
                if len(ids) > room:
                    donor.append((doc, start + room, of, ids[room:]))
                level += min(room, len(ids))
            if level < self.size:
                self._open(window, level)
                break
            full.append(window)
        return full

    def rest(self) -> list[Piece]:
        """The pieces of the one window that stays open after ``settle``."""
        return [piece for windows in self.at_level for window in windows for piece in window]


def powers(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Windows whose lengths are the powers of two that add up to all ids, the largest first."""
    left = sum(len(p[3]) for p in pieces)
    pieces = pieces[::-1]
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        window = []
        while room:
            doc, start, of, ids = pieces.pop()
            window.append((doc, start, of, ids[:room]))
            if len(ids) > room:
                pieces.append((doc, start + room, of, ids[room:]))
            room -= min(room, len(ids))
        yield window


PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, shard long"


class _Rows:
    """Pieces as rows; sequences are numbered from ``base`` on. Pieces of open windows have no sequence."""

    def __init__(self, base: int, shard: int):
        self.next, self.shard, self.rows = base, shard, []

    def add(self, window: list[Piece], closed: bool = True) -> None:
        offset = 0
        for doc, start, of, ids in window:
            self.rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), of, self.next if closed else None, offset, self.shard))
            offset += len(ids)
        self.next += closed

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 8
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in PIECES.split(", ")])


def _pack_texts(path: str, end_id: int, size: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, packer = WordEncoder(path), Packer(size)
        shard = TaskContext.get().partitionId()
        rows = _Rows(shard << 32, shard)
        for batch in batches:
            for part in parts(batch, "text"):
                ids, sizes = encoder.encode([t or "" for t in part["text"].to_pylist()])
                ends = np.cumsum(sizes)
                for doc, a, b in zip(part["id"].to_pylist(), (ends - sizes).tolist(), ends.tolist()):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    whole = len(own) // size * size
                    for at in range(0, whole, size):
                        rows.add([(doc, at, len(own), own[at : at + size])])
                    if whole < len(own):
                        for window in packer.add((doc, whole, len(own), own[whole:])):
                            rows.add(window)
                yield rows.batch()
        for window in packer.settle():
            rows.add(window)
        rows.add(packer.rest(), closed=False)
        yield rows.batch()

    return run


def _pack_rests(size: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("shard", "ascending"), ("offset", "ascending")])
        place = group["shard"][0].as_py() // TOGETHER
        packer, rows = Packer(size), _Rows((1 << 62) + (place << 32), place)
        columns = (group[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        for doc, start, of, ids in zip(*columns):
            for window in packer.add((doc, start, of, np.frombuffer(ids, "<u4"))):
                rows.add(window)
        for window in [*packer.settle(), *powers(packer.rest())]:
            rows.add(window)
        return pa.Table.from_batches([rows.batch()])

    return run


def pack_documents(docs: DataFrame, key: str, text: str, tokenizer: str, end_id: int = 1, size: int = WINDOW) -> DataFrame:
    """``key, start, length, ids (little-endian u32), doc_tokens, sequence_id, offset``: one row per piece.

    A document is the ids of its text and ``end_id``; null and empty texts are just that id. Every id lies in exactly one piece, and the
    pieces of a sequence follow each other without gaps. Sequences have ``size`` ids, but for a few per TOGETHER input partitions whose lengths
    are smaller powers of two. Rows with a null id and repeated rows are documents of their own; an empty table gives no rows. Other
    columns are not read. Which documents share a sequence follows the partitions of the input.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    path = staged_path(spark, "pieces")
    own.mapInArrow(_pack_texts(tokenizer, end_id, size), PIECES).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    left = pieces.filter("sequence_id is null").groupBy(F.expr(f"shard div {TOGETHER}")).applyInArrow(_pack_rests(size), PIECES)
    packed = pieces.filter("sequence_id is not null").unionByName(left)
    return packed.select(F.col("doc_id").alias(key), *packed.columns[1:-1])
