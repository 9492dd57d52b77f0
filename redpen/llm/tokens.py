"""Token ids in compressed blocks: a static range coder with interleaved lanes.

Documents are put in order of their ids, cut into blocks of whole documents and encoded
with one frequency table for the whole corpus. A block is decoded on its own; checkpoints
inside it let a reader start in the middle, and checksums guard the ids.

Block layout, little-endian: magic ``RANS``, version u16, bits u16, lanes u32, ids u64,
documents u32, checkpoints u32, words u64, crc32 of the ids u32, crc32 of all that follows
u32; then per document its id i64, a null mark u8 and its number of ids u64; per checkpoint the
step u64, the word position u64 and one u64 state per lane; then the u32 words. Lane l holds
the ids l, l + lanes, ... of the block; step t decodes the ids t * lanes up to (t + 1) * lanes.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from redpen.llm.batches import parts as parts_of
from redpen.llm.encoding import SpacedEncoder
from redpen.session import staged_path

BITS = 18  # the frequencies of all symbols add up to 2**BITS
LANES = 1024
BLOCK_IDS = 1 << 18  # a block ends with the document that reaches this size
CHECKPOINT_STEPS = 128
TEXT_BYTES = 24 << 20  # of texts encoded together

_HEAD = "<4sHHIQIIQII"
_MAGIC = b"RANS"

# ---------------------------------------------------------------- range coder


def quantised(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits, each at least one, close to the counts' shares."""
    size, whole = len(counts), 1 << bits
    if size > whole:
        raise ValueError(f"{size} symbols need more than {bits} bits")
    share = (counts + 1e-9) / (counts.sum() + 1e-9 * size) * (whole - size)
    freq = np.floor(share).astype(np.int64) + 1
    missing = whole - int(freq.sum())
    freq[np.argsort(np.floor(share) - share, kind="stable")[:missing]] += 1
    return freq


class Coder:
    """Encodes and decodes id arrays with a fixed frequency table."""

    def __init__(self, freq: np.ndarray, bits: int = BITS, lanes: int = LANES):
        self.bits, self.lanes = bits, lanes
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
        """(words, checkpoints): the last id is encoded first, so that decoding runs forwards."""
        whole = np.uint64(1 << self.bits)
        state = np.full(self.lanes, 1 << 31, np.uint64)
        steps = -(-len(ids) // self.lanes)
        freqs, starts = self.freq[ids], self.start[ids]
        limits = freqs << np.uint64(63 - self.bits)
        chunks, marks, written = [], [], 0
        for t in range(steps - 1, -1, -1):
            now = slice(t * self.lanes, (t + 1) * self.lanes)
            f = freqs[now]
            x = state[: len(f)]
            full = x >= limits[now]
            over = x[full]
            if len(over):
                chunks.append(over.astype(np.uint32))
                written += len(over)
                x[full] = over >> np.uint64(32)
            x += x // f * (whole - f) + starts[now]
            if t % CHECKPOINT_STEPS == 0:
                marks.append((t, written, state.copy()))
        words = np.concatenate(chunks[::-1]) if chunks else np.empty(0, np.uint32)
        return words, [(t, written - done, states) for t, done, states in reversed(marks)]

    def decode(self, words: np.ndarray, mark: tuple[int, int, np.ndarray], n_ids: int, steps: int) -> np.ndarray:
        """The ids of the ``steps`` steps from a checkpoint on; the block has ``n_ids`` ids."""
        first, at, state = mark[0], mark[1], mark[2].copy()
        bits, low = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = []
        for t in range(first, min(first + steps, -(-n_ids // self.lanes))):
            width = min(self.lanes, n_ids - t * self.lanes)
            x = state[:width]
            slot = x & low
            now = self.symbol[slot]
            x = self.freq[now] * (x >> bits) + slot - self.start[now]
            empty = x < np.uint64(1 << 31)
            n = int(np.count_nonzero(empty))
            if n:
                x[empty] = (x[empty] << np.uint64(32)) | words[at : at + n]
                at += n
            state[:width] = x
            out.append(now)
        return np.concatenate(out) if out else np.empty(0, np.uint32)


def write_block(coder: Coder, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, marks = coder.encode(ids)
    body = b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), sizes.astype("<u8").tobytes(),
        np.array([m[0] for m in marks], "<u8").tobytes(), np.array([m[1] for m in marks], "<u8").tobytes(),
        *[m[2].astype("<u8").tobytes() for m in marks], words.astype("<u4").tobytes(),
    ])
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(
        _HEAD,
        _MAGIC, 1, coder.bits, coder.lanes, len(ids), len(doc_ids), len(marks), len(words), crc, zlib.crc32(body)
    ) + body


class Block:
    """A block read back; a damaged one is a ValueError."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.lanes, self.n_ids, n_docs, n_marks, n_words, self.crc, body_crc = struct.unpack_from(_HEAD, data)
        body = memoryview(data)[struct.calcsize(_HEAD) :]
        if magic != _MAGIC or version != 1 or zlib.crc32(body) != body_crc:
            raise ValueError("not a sound block")
        at = 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(body, kind, n, at)
            at += got.nbytes
            return got

        doc_ids, nulls = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(doc_ids, nulls)]
        self.sizes = take("<u8", n_docs).astype(np.int64)
        steps, places = take("<u8", n_marks), take("<u8", n_marks)
        states = take("<u8", n_marks * self.lanes).reshape(n_marks, self.lanes)
        self.marks = [(int(s), int(p), x.astype(np.uint64)) for s, p, x in zip(steps, places, states)]
        self.words = take("<u4", n_words)

    def ids(self, coder: Coder) -> np.ndarray:
        """All ids, checked against the checksum."""
        got = coder.decode(self.words, self.marks[0], self.n_ids, 1 << 62) if self.marks else np.empty(0, np.uint32)
        if zlib.crc32(got.astype("<u4").tobytes()) != self.crc:
            raise ValueError("the ids do not match their checksum")
        return got

    def slice(self, coder: Coder, start: int, end: int) -> np.ndarray:
        """The ids start..end, decoded from the nearest checkpoint before them."""
        span = CHECKPOINT_STEPS * self.lanes
        if not start < end:
            return np.empty(0, np.uint32)
        mark = self.marks[start // span]
        base = mark[0] * self.lanes
        return coder.decode(self.words, mark, self.n_ids, -(-(end - base) // self.lanes))[start - base : end - base]


# ---------------------------------------------------------------- files

RAW = "shard int, block long, doc_ids array<long>, sizes array<long>, n_ids long, ids binary, used binary, times binary"
_RAW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("n_ids", pa.int64()), ("ids", pa.binary()), ("used", pa.binary()), ("times", pa.binary()),
])


def _raw_blocks(path: str, end_id: int):
    """Tasks get documents in order and give raw blocks of whole documents."""

    def run(batches):
        encoder, number = SpacedEncoder(path), 0
        doc_ids, parts, sizes, held, shard = [], [], [], 0, 0

        def block():
            ids = np.concatenate(parts)
            counts = np.bincount(ids)
            used = np.flatnonzero(counts)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": number, "doc_ids": doc_ids, "sizes": sizes, "n_ids": len(ids),
                "ids": _planes(ids), "used": used.astype("<u4").tobytes(), "times": counts[used].astype("<u8").tobytes(),
            }], _RAW)

        for batch in batches:
            for rows in parts_of(batch, "text", TEXT_BYTES):
                shard = rows["shard"][0].as_py()
                ids, lengths = encoder.encode(rows["text"])
                at = 0
                for doc, n in zip(rows["id"].to_pylist(), lengths.tolist()):
                    doc_ids.append(doc)
                    parts.append(np.append(ids[at : at + n], np.uint32(end_id)).astype(np.uint32))
                    sizes.append(n + 1)
                    at, held = at + n, held + n + 1
                    if held >= BLOCK_IDS:
                        yield block()
                        doc_ids, parts, sizes, held, number = [], [], [], 0, number + 1
        if doc_ids:
            yield block()
        pa.default_memory_pool().release_unused()  # the worker stays

    return run


def _planes(ids: np.ndarray) -> bytes:
    """Ids as four planes of bytes, the lowest first."""
    return b"".join((ids >> np.uint32(at)).astype(np.uint8).tobytes() for at in (0, 8, 16, 24))


def _plain(data: bytes) -> np.ndarray:
    """Ids stored as four planes of bytes, which compress better than whole ids."""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _counter(size: int):
    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for used, times in zip(batch["used"], batch["times"]):
                counts[np.frombuffer(used.as_py(), "<u4")] += np.frombuffer(times.as_py(), "<u8").astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"id": pa.array(used, pa.int64()), "n": pa.array(counts[used], pa.int64())})

    return run


def _block_writer(freq: np.ndarray):
    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                data = write_block(coder, row["doc_ids"], np.array(row["sizes"], np.int64), _plain(row["ids"]))
                yield pa.RecordBatch.from_pydict({
                    "shard": pa.array([row["shard"]], pa.int32()), "block": pa.array([row["block"]], pa.int64()),
                    "n_ids": pa.array([row["n_ids"]], pa.int64()), "data": pa.array([data], pa.binary()),
                })

    return run


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def write_tokens(docs: DataFrame, key: str, text: str, tokenizer: str, out: str, end_id: int = 0) -> None:
    """Write ``out/blocks`` (``shard, block, n_ids, data``) and ``out/frequencies`` (``id, freq``) as Parquet.

    Documents are in ascending order of ``key`` (null ids first; rows with the same id by their text),
    shard by shard and block by block. Null and empty texts are just the end id. Other
    columns are not read. An empty table gives no blocks.

    Texts move once, to ranges of ids. Ids are staged, so that texts are encoded once although
    the frequency table must be known before the first block is written.
    """
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    ordered = own.repartitionByRange("id").sortWithinPartitions("id", "text").withColumn("shard", F.spark_partition_id())
    raw_path = staged_path(docs.sparkSession, "raw-ids")
    ordered.mapInArrow(_raw_blocks(tokenizer, end_id), RAW).write.option("compression", "zstd").parquet(raw_path)
    raw = docs.sparkSession.read.schema(RAW).parquet(raw_path)
    size = vocabulary_size(tokenizer)
    counts = raw.select("used", "times").mapInArrow(_counter(size), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    tally = np.zeros(size, np.int64)
    for row in counts.collect():  # at most one row per vocabulary entry
        tally[row["id"]] = row["n"]
    freq = quantised(tally)
    spark = docs.sparkSession
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq)], "id int, freq int").coalesce(1).write.parquet(f"{out}/frequencies")
    raw.mapInArrow(_block_writer(freq), "shard int, block long, n_ids long, data binary").write.parquet(f"{out}/blocks")


def _frequencies(spark: SparkSession, out: str) -> np.ndarray:
    return np.array([r["freq"] for r in spark.read.parquet(f"{out}/frequencies").orderBy("id").collect()], np.int64)


READ = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"


def _block_reader(freq: np.ndarray, with_ids: bool):
    def run(batches):
        coder = Coder(freq)
        for batch in batches:
            for at in range(batch.num_rows):
                (row,) = batch.slice(at, 1).to_pylist()
                block = Block(row["data"])
                ids = block.ids(coder).astype("<u4")
                ends = np.cumsum(block.sizes)
                starts = ends - block.sizes
                parts = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(block.doc_ids, pa.int64()), "start": pa.array(starts + row["before"], pa.int64()),
                    "n_tokens": pa.array(block.sizes, pa.int64()),
                    "ids": pa.array(parts if with_ids else [None] * len(parts), pa.binary()),
                    "ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64()),
                })

    return run


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids (little-endian u32), ids_crc32`` from the files; blocks are read in parallel."""
    blocks = spark.read.parquet(f"{out}/blocks")
    # places of blocks come from their sizes alone: one small row per shard, then sums inside a shard
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("held"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    places = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start"))
    places = places.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("before"))
    placed = blocks.join(places, ["shard", "block"]).select("before", "data")
    return placed.mapInArrow(_block_reader(_frequencies(spark, out), with_ids), READ)


def token_file_path(spark: SparkSession) -> str:
    return staged_path(spark, "token-blocks")
