"""Near duplicates: MinHash bands propose pairs, odd sketches estimate them, full sets decide.

An odd sketch folds the MinHash samples of a document into the parities of 512 counters. The xor of two sketches
is the sketch of the samples that differ, and its population count tells how many there are.
A second sketch folds the whole set into twice as many counters as it has members or more; it has no sampling error.
Pairs clearly below the limit in either are dropped; the others are compared on their full sets of shingles.

Documents with the same set of shingles are one class and go through everything once. A bucket links its members to
its smallest one only; members that end up in different components are compared
with each other afterwards, so no link between components is lost and no bucket emits all its pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from redpen.llm.batches import lists, parts
from redpen.llm.components import components
from redpen.llm.words import hashed_texts, joined, signed
from redpen.session import stage

SHINGLE = 5
SHARE = 75  # link when 100 * intersection >= SHARE * union
BANDS, ROWS = 48, 5  # a pair at 0.75 meets in no band with chance (1 - 0.75**5)**48 = 2.3e-6
SAMPLES = BANDS * ROWS
BITS = 512
MARGIN = 0.17  # five standard errors of the estimate at 0.75
ERRORS = 5.0  # standard errors that the sketch of the whole set is given
TOGETHER = 512  # members of a group that are compared with their centre in one place
CROWDED = 1024  # members of a bucket from which on a second common band is asked for
FILTER_BITS = 1 << 26  # of the bitmap that tells which texts are wanted; its size is fixed

# ---------------------------------------------------------------- sets and signatures


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle, one without words none."""
    tokens, sizes = hashed_texts(texts)
    ends = np.cumsum(sizes)
    keys = tokens
    for step in range(1, SHINGLE):
        keys = joined(keys[:-1], tokens[step:]) if len(keys) > 1 else keys[:0]
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist()):
        if size >= SHINGLE:
            out.append(np.unique(keys[end - size : end - SHINGLE + 1]))
        elif size:
            whole = np.array([size], np.uint64)
            for i in range(end - size, end):
                whole = joined(whole, tokens[i : i + 1])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _multipliers() -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def min_hashes(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The smallest product with each multiplier, block by block, so that a long text needs no large matrix."""
    low = np.full(len(multipliers), ~np.uint64(0))
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (multipliers[:, None] * shingles[None, at : at + 1024]).min(1), out=low)
    return low


def band_keys(samples: np.ndarray) -> np.ndarray:
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        key = joined(key, column)
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parities of 512 counters as eight 64-bit words; each sample counts where the hash of place and value says."""
    places = joined(np.arange(len(samples), dtype=np.uint64), samples) >> np.uint64(64 - 9)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.uint64)


def whole_sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of a power of two of counters, two to four per shingle, as 64-bit words; and the same with half as many.

    A counter takes the shingles with its low bits, so the xor of both halves is the sketch of half the size. Sets
    that can be linked differ in size by less than two, so one of both fits.
    """
    counters = max(128, 1 << int(2 * len(shingles) - 1).bit_length())
    places = (shingles & np.uint64(counters - 1)).astype(np.int64)
    words = np.packbits((np.bincount(places, minlength=counters) & 1).astype(np.uint8)).view(np.uint64)
    return words, words[: len(words) // 2] ^ words[len(words) // 2 :]


def most_bits(similarity: float) -> int:
    """The population count of the xor that is expected at a similarity."""
    differing = 2 * SAMPLES * (1 - similarity)
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * differing / BITS)))


def may_link(a: Column, b: Column) -> Column:
    """Whether two structs ``n_shingles, sketch, whole, half`` allow the limit.

    Sets at the limit differ in d = (100 - SHARE) / (100 + SHARE) of their summed sizes. The whole sketches then differ in no more
    than d counters, and but for chance in no more than expected plus ERRORS standard errors.
    """
    bits = sum((F.bit_count(a["sketch"][i].bitwiseXOR(b["sketch"][i])) for i in range(1, BITS // 64)), F.bit_count(a["sketch"][0].bitwiseXOR(b["sketch"][0])))
    longer, shorter = F.size(a["whole"]) > F.size(b["whole"]), F.size(a["whole"]) < F.size(b["whole"])
    x, y = F.when(longer, a["half"]).otherwise(a["whole"]), F.when(shorter, b["half"]).otherwise(b["whole"])
    differing = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, z: s + z)
    counters = F.least(F.size(a["whole"]), F.size(b["whole"])) * 64.0
    most = F.floor((a["n_shingles"] + b["n_shingles"]) * (100 - SHARE) / (100 + SHARE))
    expected = counters / 2 * (1 - F.exp(-2 * most / counters))
    spread = F.sqrt(F.greatest(counters / 4 * (1 - F.exp(-4 * most / counters)) - most * F.exp(-4 * most / counters), F.lit(0.0)))
    sizes = 100 * F.least(a["n_shingles"], b["n_shingles"]) >= SHARE * F.greatest(a["n_shingles"], b["n_shingles"])
    return sizes & (bits <= most_bits(SHARE / 100 - MARGIN)) & (differing <= F.least(most, expected + ERRORS * spread + 1))


SIGNED = "id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, whole array<long>, half array<long>"


def _sign(batches):
    import xxhash

    multipliers = _multipliers()
    none = np.empty(0, np.uint64)
    for batch in batches:
        for part in parts(batch, "text"):
            sets = shingle_sets(part["text"].to_pylist())
            sizes = np.array([len(s) for s in sets], np.int64)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            samples = [min_hashes(s, multipliers) if len(s) else none for s in sets]
            columns = [
                [band_keys(x) if len(x) else none for x in samples], [odd_sketch(x) if len(x) else none for x in samples],
                *zip(*[whole_sketch(s) if len(s) else (none, none) for s in sets]),
            ]
            yield pa.RecordBatch.from_arrays([
                part["id"].cast(pa.int64()), pa.array(sizes), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                *[lists(signed(np.concatenate([none, *c])), np.array([len(x) for x in c]), pa.int64()) for c in columns],
            ], ["id", "n_shingles", "set_a", "set_b", "bands", "sketch", "whole", "half"])


# ---------------------------------------------------------------- pairs


def signature() -> Column:
    return F.struct("n_shingles", "sketch", "whole", "half").alias("s")


def sketched(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose sizes and sketches allow the limit."""
    side = classes.select("rep", signature())
    both = pairs.join(side.toDF("a", "s_a"), "a").join(side.toDF("b", "s_b"), "b")
    return both.filter(may_link(F.col("s_a"), F.col("s_b"))).select("a", "b")


def _compare(batches):
    """Rows sorted by group, its centre first: the members that are linked with the centre."""
    centre, held = None, np.empty(0, np.uint64)
    for batch in batches:
        for part in parts(batch, "text"):
            found = []
            rows = zip(*(part[c].to_pylist() for c in ("a", "b")), shingle_sets(part["text"].to_pylist()))
            for a, b, own in rows:
                if b is None:
                    centre, held = a, own
                elif a == centre:
                    common = len(np.intersect1d(held, own, assume_unique=True))
                    if 100 * common >= SHARE * (len(held) + len(own) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _places(ids: np.ndarray) -> np.ndarray:
    return (joined(ids.view(np.uint64), np.zeros(1, np.uint64)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _marks(batches):
    for batch in batches:
        places = np.unique(_places(batch["id"].to_numpy()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(places >> 6), "bits": pa.array((np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64))})


def only_wanted(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose id is in ``wanted``, and a few others: what a bitmap of fixed size lets through.

    It spares the shuffle of texts that no pair needs; a join decides afterwards.
    """
    marks = wanted.select("id").mapInArrow(_marks, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = marks.toArrow()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    held = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        words = held.value
        for batch in batches:
            places = _places(batch["id"].to_numpy())
            hit = words[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return texts.filter("id is not null").mapInArrow(run, "id long, text string")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough; ``texts`` has ``id, text``.

    Texts of the documents in pairs move to their centres. A centre with many members is copied to several places, each with a
    bounded number of them, so no group meets in one task.
    """
    places = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("places"))
    members = pairs.join(places, "a").select("a", F.col("b").alias("id"), F.col("b"), F.pmod(F.xxhash64("b"), F.col("places")).cast("int").alias("place"))
    centres = places.select("a", F.col("a").alias("id"), F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"))
    wanted = members.unionByName(centres)
    rows = wanted.join(only_wanted(texts, wanted), "id").select("a", "place", "b", "text")
    ordered = rows.repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())
    return ordered.select("a", "b", "text").mapInArrow(_compare, "a long, b long")


def _words(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit words of each row of a list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    return np.split(flat, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])


def _whole_fits(n: int, whole_x, half_x, whole_y, half_y) -> bool:
    """The test of ``may_link`` on the sketches of whole sets, for sets with ``n`` shingles together."""
    x, y = (half_x if len(whole_x) > len(whole_y) else whole_x), (half_y if len(whole_y) > len(whole_x) else whole_y)
    differing, counters = int(np.bitwise_count(x ^ y).sum()), 64.0 * min(len(whole_x), len(whole_y))
    most = n * (100 - SHARE) // (100 + SHARE)
    expected, again = counters / 2 * (1 - math.exp(-2 * most / counters)), math.exp(-4 * most / counters)
    spread = math.sqrt(max(counters / 4 * (1 - again) - most * again, 0.0))
    return differing <= min(most, expected + ERRORS * spread + 1)


def _pairs_apart(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of one bucket: members in different components whose sizes and sketches allow the limit."""
    reps, comps, sizes = (rows[c].to_numpy() for c in ("rep", "component", "n_shingles"))
    sketch = np.stack(_words(rows["sketch"].combine_chunks()))
    whole, half = (_words(rows[c].combine_chunks()) for c in ("whole", "half"))
    out = []
    for i in range(0, len(reps), 256):
        for j in range(0, len(reps), 1024):
            a, b = slice(i, i + 256), slice(j, j + 1024)
            fits = (comps[a, None] != comps[None, b]) & (reps[a, None] < reps[None, b])
            fits &= 100 * np.minimum(sizes[a, None], sizes[None, b]) >= SHARE * np.maximum(sizes[a, None], sizes[None, b])
            if not fits.any():
                continue
            bits = sum(np.bitwise_count(sketch[a, None, w] ^ sketch[None, b, w]).astype(np.int64) for w in range(BITS // 64))
            for x, y in zip(*(k.tolist() for k in np.nonzero(fits & (bits <= most_bits(SHARE / 100 - MARGIN))))):
                x, y = x + i, y + j
                if _whole_fits(int(sizes[x] + sizes[y]), whole[x], half[x], whole[y], half[y]):
                    out.append((reps[x], reps[y]))
    return tuple(np.array([p[k] for p in out], np.int64) for k in (0, 1))


def _apart(batches):
    """Rows sorted by band: the pairs of each bucket. A task holds one bucket at a time."""
    held: list[pa.Table] = []

    def found() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in _pairs_apart(pa.concat_tables(held))], ["a", "b"])

    for batch in batches:
        bands = batch["band"].to_numpy()
        edges = np.flatnonzero(np.append(True, bands[1:] != bands[:-1])) if len(bands) else np.empty(0, np.int64)
        for low, high in zip(edges, np.append(edges[1:], len(bands))):
            if held and held[0]["band"][0].as_py() != bands[low]:
                yield found()
                held.clear()
            held.append(pa.Table.from_batches([batch.slice(low, high - low)]))
    if held:
        yield found()


def across(buckets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``a, b`` that share a bucket and lie in different components so far.

    Only buckets with several components are looked at. From CROWDED members on a pair must share a second such bucket as
    well, which a pair at the limit does with all but chance 4e-5. A document's sketches are looked up once and go along to its buckets.
    """
    placed = buckets.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    left = stage(_several(placed), "mixed-buckets")
    few = left.filter(F.col("held") < CROWDED).select("band", "rep", "component")
    # a second bucket with fewer members is met by itself
    many = left.filter(F.col("held") >= CROWDED).groupBy("rep", "component").agg(F.collect_list("band").alias("bands"))  # at most BANDS
    again = many.select("rep", "component", "bands", F.explode("bands").alias("band")).select("rep", "component", "band", F.explode("bands").alias("other"))
    again = _several(again.filter("band < other").select(F.xxhash64("band", "other").alias("band"), "rep", "component"))
    members = few.unionByName(again.select("band", "rep", "component"))
    documents = members.groupBy("rep", "component").agg(F.collect_list("band").alias("bands"))
    side = documents.join(classes.select("rep", "n_shingles", "sketch", "whole", "half"), "rep")
    met = side.select(F.explode("bands").alias("band"), *side.drop("bands").columns).repartition("band").sortWithinPartitions("band")
    return met.mapInArrow(_apart, "a long, b long").distinct()


def _several(placed: DataFrame) -> DataFrame:
    """The rows of buckets with several components, and how many rows the bucket has."""
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("held"))
    return placed.join(mixed.filter("least < most").select("band", "held"), "band")


def near_duplicates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, n_shingles, component_id, kept``: one row per input row.

    ``component_id`` is the smallest id reachable by links, ``kept`` says that it is the row's own. Documents without words and rows
    without an id link with nothing; a row without an id has no component and is kept. Repeated rows are exact copies: they share
    a component, and rows with the smallest id are all kept. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signatures = stage(texts.mapInArrow(_sign, SIGNED), "signatures")
    linked = signatures.filter("id is not null and n_shingles > 0")
    classes = linked.groupBy("set_a", "set_b").agg(
        F.min("id").alias("rep"), F.any_value("n_shingles").alias("n_shingles"), *[F.any_value(c).alias(c) for c in ("bands", "sketch", "whole", "half")]
    )
    classes = stage(classes, "classes")
    bands = classes.select(F.explode("bands").alias("band"), "rep")
    shared = bands.groupBy("band").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).filter("centre < last")
    buckets = stage(bands.join(shared.select("band", "centre"), "band"), "buckets")
    stars = buckets.filter("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    links = stage(confirmed(stage(sketched(stars, classes), "pairs"), texts), "links")
    labels = stage(components(links), "labels")
    more = stage(across(buckets, classes, labels).join(links, ["a", "b"], "left_anti"), "pairs")
    if more.limit(1).count():
        links = links.unionByName(stage(confirmed(more, texts), "links"))
        labels = stage(components(links), "labels")
    of_class = classes.select("set_a", "set_b", "rep").join(labels.toDF("rep", "component"), "rep", "left")
    of_class = of_class.select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    alone = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.struct("set_a", "set_b"))
    found = signatures.select("id", "n_shingles", alone.alias("of")).join(
        of_class.select(F.struct("set_a", "set_b").alias("of"), "component"), "of", "left"
    )
    return found.select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("component", "id") == F.col("id"))).alias("kept"),
    )
