"""Quality by perplexity: an interpolated modified Kneser-Ney trigram model of trusted text.

Sequences of all trusted texts that train are counted in Spark, and all have weights, those seen once too (``least`` can
prune the rarer ones; their share then goes to the shorter sequences, so chances still add up to one). The log chance of a text is a sum
over its words, pairs and triples: each has one weight, what it changes against the shorter sequences. The weights are
a Spark table of any size. Its HEAD most frequent rows go to every task, where most of a text is scored where it
lies; words, pairs and triples that a filter of fixed size finds among the other rows are joined with those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from redpen.llm.batches import lists, parts
from redpen.llm.words import Lookup, hashed_texts, hashes, joined, signed
from redpen.session import stage, unstage

TRAIN_ROWS: int | None = None  # documents per language that the model is fitted on, chosen by a hash of the ids; None: all
HEAD = 1 << 21  # weights that go to every task, the most frequent ones
FILTER_BITS = 1 << 26  # of the filter for the other weights
PROBES = 4  # places that a key has in the filter
LANGUAGES = 1_000  # largest languages with a threshold of their own; others share one
QUANTILE = 0.995  # of the trusted text that must pass
PRIOR_WORDS = 20  # median words added to each text, so that short texts are not judged by one word

BEGIN, END = b"\t", b"\n"  # no word holds them


def _padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sizes) with two begin marks before and an end mark behind each text."""
    tokens, sizes = hashed_texts(texts, END)
    out = np.full(len(tokens) + 2 * len(sizes), hashes([BEGIN])[0], np.uint64)
    place = np.arange(len(tokens)) + 2 * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    out[place] = tokens
    return out, place


COUNTS = "first long, before long, word long, n long"


def _count(batches):
    for batch in batches:
        for part in parts(batch, "text"):
            tokens, place = _padded(part["text"].to_pylist())
            words = tokens[place - 2], tokens[place - 1], tokens[place]
            # in the order of their pairs, which packs well
            order = np.lexsort((words[0], words[2], words[1]))
            words = [w[order] for w in words]
            new = np.flatnonzero(np.append(True, np.any([w[1:] != w[:-1] for w in words], axis=0))) if len(order) else order
            n = np.diff(np.append(new, len(order)))
            yield pa.RecordBatch.from_arrays([*[pa.array(signed(w[new])) for w in words], pa.array(n, pa.int64())], ["first", "before", "word", "n"])


def _weight_keys(batches):
    """Keys of pairs, and of triples where there is a first word."""
    for batch in batches:
        before, word = (batch[c].to_numpy().view(np.uint64) for c in ("before", "word"))
        first = batch["first"].fill_null(0).to_numpy().view(np.uint64)
        alone = batch["first"].is_null().to_numpy(zero_copy_only=False)
        keys = np.where(alone, joined(before, word), joined(joined(first, before), word))
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), batch["value"], batch["n"]], ["key", "value", "n"])


def discounts(*times: float) -> list[float]:
    """Modified Kneser-Ney discounts of counts one, two, and three or more, from how many sequences have the counts one to four; 0.5, 1, 1.5 where too few were seen."""
    n1, n2, n3, n4 = (float(x or 0) for x in times)
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.05), i - 0.05) for i, d in enumerate(found, 1)]


def _times(*of: int) -> list[Column]:
    return [F.count_if(F.col("n") == i) for i in of]


def _discounted(n: str, by: list[float]) -> Column:
    return F.col(n) - F.when(F.col(n) == 1, by[0]).when(F.col(n) == 2, by[1]).otherwise(by[2])


@dataclass
class Model:
    """Weights by hash: the most frequent ones as arrays, the others as a table and a filter of their keys."""

    keys: np.ndarray
    values: np.ndarray
    unknown: float  # log10 chance of a word that was never seen
    rest: DataFrame | None = None
    bits: np.ndarray | None = None

    def lookups(self) -> tuple[Lookup, np.ndarray, float, np.ndarray | None]:
        return Lookup(self.keys), np.append(self.values, 0.0), self.unknown, self.bits


def _key_bits(rows: DataFrame) -> np.ndarray:
    """A bitmap of the places of all keys, FILTER_BITS long whatever the table: the lower half of a key and steps of its upper half."""
    low, high = F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("key", 32).bitwiseOR(F.lit(1))
    places = rows.select(F.explode(F.array(*[(low + i * high).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(PROBES)])).alias("place"))
    bits = places.select(F.shiftright("place", 6).alias("at"), F.expr("1L").alias("one"), F.col("place").bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    got = bits.groupBy("at").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return bitmap


def weights(trusted: DataFrame, text: str, least: int) -> tuple[DataFrame, float]:
    """(``key, value, n``, log10 chance of an unknown word): what each word, pair and triple adds to the log chance of a text.

    A word adds its own chance and, as a context, the share it leaves to shorter sequences; a pair and a triple add what they change.
    Pairs and triples with counts below ``least`` have no weight of their own.
    """
    counted = trusted.select(F.col(text).alias("text")).mapInArrow(_count, COUNTS)
    triples = counted.repartition("before", "word").groupBy("before", "word", "first").agg(F.sum("n").alias("n"))
    # a pair counts the different words before it; its first row stands for it, pruned triples go no further
    of_pair = Window.partitionBy("before", "word")
    at = F.row_number().over(of_pair.orderBy("first")).alias("at")
    counts = triples.select("*", at, F.count(F.lit(1)).over(of_pair).alias("lefts"), F.sum("n").over(of_pair).alias("uses"))
    counts = stage(counts.filter((F.col("at") == 1) | (F.col("n") >= least)), "counts")
    pairs = counts.filter("at = 1").select("before", "word", F.col("lefts").alias("n"), "uses")
    kept = counts.filter(F.col("n") >= least).select("first", "before", "word", "n")
    words = stage(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "words")
    end = int(signed(hashes([END]))[0])
    *times, all_triples, texts = pairs.agg(*_times(1, 2, 3, 4), F.sum("n"), F.sum(F.when(F.col("word") == end, F.col("uses")))).first()
    by2 = discounts(*times)
    again, *times = kept.agg(F.count_if(F.col("n") > 1), *_times(2, 3, 4)).first()
    by3 = discounts((all_triples or 0) - again, *times)
    by1 = discounts(*words.agg(*_times(1, 2, 3, 4)).first())
    total, size, left = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.col("n") - _discounted("n", by1)), F.lit(0.0))).first()
    unknown = (left / total if total else 1.0) / (size + 1)  # discounted mass, spread evenly over the words and one unknown word
    chance1 = words.select("word", (_discounted("n", by1) / (total or 1) + unknown).alias("p1"), F.col("n").alias("n1"))

    held = F.sum(F.when(F.col("n") >= least, _discounted("n", by2)).otherwise(0.0))
    befores = stage(pairs.groupBy("before").agg(F.sum("n").alias("total"), (1.0 - held / F.sum("n")).alias("gamma")), "befores")
    own = F.when(F.col("n") >= least, _discounted("n", by2) / F.col("total")).otherwise(0.0)
    shorter = F.col("gamma") * F.col("p1")
    # every pair that was seen so often, also those with one word before them
    known = pairs.filter(F.col("uses") >= least).join(befores, "before").join(chance1.drop("n1"), "word")
    chance2 = stage(known.select("before", "word", "n", "uses", shorter.alias("short"), (own + shorter).alias("p2")), "pair-chances")
    # a pair is a context as often as it was seen, only the two begin marks are no pair
    mark = int(signed(hashes([BEGIN]))[0])
    totals = chance2.select(F.col("before").alias("first"), F.col("word").alias("before"), F.col("uses").alias("total"))
    totals = totals.unionByName(trusted.sparkSession.createDataFrame([(mark, mark, texts or 1)], totals.schema))
    contexts = kept.groupBy("first", "before").agg(F.sum(_discounted("n", by3)).alias("held")).join(totals, ["first", "before"])
    contexts = stage(contexts.select("first", "before", "total", (1.0 - F.col("held") / F.col("total")).alias("gamma")), "contexts")
    # written between the joins, so that the shuffles of one are gone before the next
    longer = stage(kept.join(chance2.select("before", "word", "p2"), ["before", "word"]), "longer")
    unstage(counts)
    change = F.log10(_discounted("n", by3) / F.col("total") + F.col("gamma") * F.col("p2")) - F.log10(F.col("gamma") * F.col("p2"))
    keyed = "key long, value double, n long"
    of_triples = longer.join(contexts, ["first", "before"]).select("first", "before", "word", change.alias("value"), "n").mapInArrow(_weight_keys, keyed)
    of_triples = stage(of_triples, "triple-weights")
    unstage(longer)

    none = F.lit(None).cast("long").alias("first")
    of_pairs = chance2.filter(F.col("n") >= least).select(none, "before", "word", (F.log10("p2") - F.log10("short")).alias("value"), "n").unionByName(
        contexts.select(none, F.col("first").alias("before"), F.col("before").alias("word"), F.log10("gamma").alias("value"), F.col("total").alias("n"))
    )
    united = (
        of_pairs.mapInArrow(_weight_keys, keyed)
        .unionByName(chance1.select(F.col("word").alias("key"), (F.log10("p1") - F.log10(F.lit(unknown))).alias("value"), F.col("n1").alias("n")))
        .unionByName(befores.filter("gamma < 1").select(F.col("before").alias("key"), F.log10("gamma").alias("value"), F.col("total").alias("n")))
    )
    # words and pairs have a weight of their own and one as a context, triples only one
    table = stage(united.groupBy("key").agg(F.sum("value").alias("value"), F.max("n").alias("n")), "weights").unionByName(of_triples)
    unstage(words, befores, chance2, contexts)
    return table, float(np.log10(unknown))


def fit(trusted: DataFrame, text: str, least: int = 2) -> Model:
    """A model of all the texts; pairs and triples with counts below ``least`` are pruned."""
    table, unknown = weights(trusted, text, least)
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("step")).collect()  # at most 512 rows
    upto = np.cumsum([r["rows"] for r in sizes])
    whole = not len(upto) or upto[-1] <= HEAD
    lowest = 0 if whole else min((r["step"] for r, n in zip(sizes, upto) if n <= HEAD), default=1 << 20)
    got = table.filter(step >= lowest).select("key", "value").toArrow()
    keys, values = got[0].to_numpy().astype(np.int64).view(np.uint64), got[1].to_numpy().astype(float)
    if whole:
        return Model(keys, values, unknown)
    rest = table.filter(step < lowest).select("key", "value")
    return Model(keys, values, unknown, rest, _key_bits(rest))


def _maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that may be in the table of a filter; none that is there is missed."""
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    left = np.arange(len(keys))
    for i in range(PROBES):
        spot = (low[left] + np.uint64(i) * high[left]) & np.uint64(64 * len(bits) - 1)
        left = left[(bits[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return left


def _scored(lookups, texts: list[str | None]):
    """(sum of log10 chances, tokens) of each text with the weights at hand; text and key of the others, each once, with its number."""
    table, values, unknown, bits = lookups
    tokens, place = _padded(texts)
    owner = place - 2 - np.arange(len(place))
    owner //= 2
    sizes = np.bincount(owner, minlength=len(texts))
    of = np.repeat(np.arange(len(sizes)), sizes + 2)
    inner = np.flatnonzero(np.append(False, of[1:] == of[:-1])) if len(of) else of
    pair = np.zeros(len(tokens), np.uint64)
    pair[inner] = joined(tokens[inner - 1], tokens[inner])
    keys = np.concatenate([tokens[inner], pair[inner], joined(pair[place - 1], tokens[place])])
    of = np.concatenate([of[inner], of[inner], owner])
    at = table.find(keys)
    logs = np.bincount(of, values[at], len(texts)) + sizes * unknown
    if bits is None:
        return logs, sizes, None
    # no pair has a weight whose second word has none, the begin marks apart, and no triple whose first two words have none
    maybe, n = np.zeros(len(keys), bool), len(inner)

    def look(part: slice, possible: np.ndarray | bool) -> np.ndarray:
        """Which keys have a weight or may have one; these are marked."""
        left = np.flatnonzero(possible & (at[part] < 0))
        maybe[part][left[_maybe(bits, keys[part][left])]] = True
        return maybe[part] | (at[part] >= 0)

    word_here = look(slice(0, n), True) | (tokens[inner] == hashes([BEGIN])[0])
    pair_here = np.zeros(len(tokens), bool)
    pair_here[inner] = look(slice(n, 2 * n), word_here)
    look(slice(2 * n, None), pair_here[place - 1])
    asked = np.flatnonzero(maybe)
    asked = asked[np.lexsort((keys[asked], of[asked]))]
    keys, of = keys[asked], of[asked]
    new = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]))) if len(keys) else asked
    return logs, sizes, (of[new], keys[new], np.diff(np.append(new, len(keys))))


def log_chances(lookups, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of log10 chances, tokens) of each text, its end mark included, for a model whose weights are all at hand."""
    return _scored(lookups, texts)[:2]


def scored(docs: DataFrame, key: str, text: str, lang: str, model: Model) -> DataFrame:
    """``_row, _id, _lang, _log, _n``: a hash of the row, the summed log10 chance and the number of tokens of its text.

    Texts are scored where they lie. Only the keys that may be in the rest of the model move, with the hash of their row.
    """
    # plain arrays, because a broadcast of our own class would need the package on the executors
    held = docs.sparkSession.sparkContext.broadcast((model.keys, model.values, model.unknown, None, model.bits))

    def run(batches):
        keys, values, unknown, _, bits = held.value
        lookups = Model(keys, values, unknown, None, bits).lookups()
        for batch in batches:
            for part in parts(batch, "_text"):
                logs, sizes, rest = _scored(lookups, part["_text"].to_pylist())
                out = [*(part[c] for c in ("_row", "_id", "_lang")), pa.array(logs), pa.array(sizes, pa.int64())]
                if rest is not None:
                    per_text = np.bincount(rest[0], minlength=part.num_rows)
                    out += [lists(signed(rest[1]), per_text, pa.int64()), lists(rest[2], per_text, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, names)

    own = docs.select(row_hash(key, text, lang).alias("_row"), F.col(key).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    kinds = dict(own.dtypes)
    fields = f"_row long, _id {kinds['_id']}, _lang {kinds['_lang']}, _log double, _n long"
    names = ["_row", "_id", "_lang", "_log", "_n"]
    if model.rest is None:
        return own.mapInArrow(run, fields)
    names += ["_keys", "_times"]
    found = stage(own.mapInArrow(run, f"{fields}, _keys array<long>, _times array<int>"), "part-scores")
    asked = found.select("_row", F.explode(F.arrays_zip("_keys", "_times")).alias("x")).select("_row", F.col("x._keys").alias("key"), F.col("x._times").alias("times"))
    more = asked.join(model.rest, "key").groupBy("_row").agg(F.sum(F.col("value") * F.col("times")).alias("_more"))
    # equal rows have the same hash and asked for the same keys: they count once and come back as often as they were
    firsts = [F.first(c).alias(c) for c in ("_id", "_lang", "_log", "_n")]
    rows = found.groupBy("_row").agg(*firsts, F.count(F.lit(1)).alias("_equal")).join(more, "_row", "left")
    whole = rows.withColumn("_log", F.col("_log") + F.coalesce(F.col("_more") / F.col("_equal"), F.lit(0.0)))
    return whole.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("_equal")))).select("_row", "_id", "_lang", "_log", "_n")


def row_hash(key: str, text: str, lang: str) -> Column:
    return F.xxhash64(key, lang, text)


def trusted_rows(docs: DataFrame, trusted: DataFrame, key: str, text: str, lang: str) -> tuple[DataFrame, DataFrame]:
    """(ids of the documents that train, ids of the other trusted documents), both as ``_id``.

    Trusted documents with ``trains`` false (all train where there is no such column) are only used for thresholds. The others
    are dealt by a hash of their ids: one half trains, all others set the thresholds, so none is judged by a model that has seen it.
    With TRAIN_ROWS, the rows of a language above it set thresholds as well. Only ids move.
    """
    trains = F.coalesce(F.col("trains"), F.lit(False)) if "trains" in trusted.columns else F.lit(True)
    ids = trusted.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.min(trains).alias("_trains"))
    order = F.pmod(F.xxhash64("_id", F.lit("deal")), F.lit(2_000_000))
    known = docs.select(F.col(key).alias("_id"), F.col(lang).alias("_lang")).join(ids, "_id").withColumn("_order", order)
    known = stage(known, "trusted")
    chosen = known.filter("_order < 1000000 and _trains")
    if TRAIN_ROWS is not None:
        so_far = Window.partitionBy("_lang").orderBy("_order", "_id")
        chosen = chosen.withColumn("_rank", F.row_number().over(so_far)).filter(F.col("_rank") <= TRAIN_ROWS)
    chosen = stage(chosen.select("_id").distinct(), "trained-on")
    return chosen, known.select("_id").distinct().join(chosen, "_id", "left_anti")


@dataclass
class Judge:
    """A model with the median and the limit of the mean negative log chance by language (None for the others)."""

    model: Model
    limits: dict[str | None, tuple[float, float]]


def prior_mean(log: Column, n: Column, median: Column) -> Column:
    """Mean negative log chance per token with PRIOR_WORDS tokens at the median."""
    return (median * PRIOR_WORDS - log) / (n + PRIOR_WORDS)


def learn(docs: DataFrame, trusted: DataFrame, key: str, text: str, lang: str) -> tuple[Judge, DataFrame]:
    """(judge, scores of all documents as ``_row, _id, _lang, _log, _n``): the model of the trusted documents that train and the limits
    on all other trusted documents."""
    chosen, others = trusted_rows(docs, trusted, key, text, lang)
    model = fit(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id", "left_semi"), "_text", least=1)
    scores = stage(scored(docs, key, text, lang, model), "scores")
    means = stage(scores.filter("_n > 1").join(others, "_id", "left_semi"), "trusted-means")

    def quantiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        typical = rows.groupBy(*keys).agg(F.percentile_approx(-F.col("_log") / F.col("_n"), 0.5, 10_000).alias("median"), F.count(F.lit(1)).alias("rows"))
        joined_ = rows.join(F.broadcast(typical.orderBy(F.desc("rows")).limit(LANGUAGES)), keys) if keys else rows.withColumn("median", F.lit(typical.first()["median"]))
        mean = prior_mean(F.col("_log"), F.col("_n"), F.col("median"))
        return joined_.groupBy(*keys, "median").agg(F.percentile_approx(mean, QUANTILE, 10_000).alias("high"))

    def limit(row) -> tuple[float, float]:
        return float(row["median"]), float(row["high"])

    limits: dict[str | None, tuple[float, float]] = {r["_lang"]: limit(r) for r in quantiles(means.filter("_lang is not null"), ["_lang"]).collect()}
    overall = quantiles(means, []).first()
    limits[None] = limit(overall) if overall else (0.0, float("inf"))
    return Judge(model, limits), scores


def with_verdicts(scores: DataFrame, lang: str, judge: Judge) -> DataFrame:
    """All columns and ``_tokens, _perplexity, _limit, _kept`` from ``_log, _n``. Row-local.

    A text is kept when its perplexity, with PRIOR_WORDS median words added, is within the limit of its language; languages
    without trusted text and null share the overall limit. Null texts and texts without words have no perplexity and are not kept.
    """
    rows = [(k, *v) for k, v in judge.limits.items() if k is not None]
    table = scores.sparkSession.createDataFrame(rows, "_of string, _own_median double, _own_limit double")  # at most LANGUAGES rows
    own = scores.join(F.broadcast(table), F.col(lang) == F.col("_of"), "left")
    median, limit = (F.coalesce(c, F.lit(d)) for c, d in zip(("_own_median", "_own_limit"), judge.limits[None]))
    mean = prior_mean(F.col("_log"), F.col("_n"), median)
    return own.select(
        *scores.columns, (F.col("_n") - 1).alias("_tokens"), F.when(F.col("_n") > 1, F.pow(F.lit(10.0), -F.col("_log") / F.col("_n"))).alias("_perplexity"),
        F.pow(F.lit(10.0), limit).alias("_limit"), ((F.col("_n") > 1) & (mean <= limit)).alias("_kept"),
    )


def classify(docs: DataFrame, trusted: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``key, lang, n_tokens, perplexity, limit, kept``: one row per input row.

    ``trusted`` has the ids of trusted documents. Without any, everything with words is kept. Repeated rows are judged
    alike; an empty table gives no rows. Other columns are not read.
    """
    judge, scores = learn(docs, trusted, key, text, lang)
    return with_verdicts(scores, "_lang", judge).select(
        F.col("_id").alias(key), F.col("_lang").alias(lang), F.col("_tokens").alias("n_tokens"),
        F.col("_perplexity").alias("perplexity"), F.col("_limit").alias("limit"), F.col("_kept").alias("kept"),
    )


def keep_good(docs: DataFrame, trusted: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """The rows of ``docs`` that are kept, whole; verdicts come back by the hash of the row."""
    judge, scores = learn(docs, trusted, key, text, lang)
    kept = with_verdicts(scores, "_lang", judge).filter("_kept").select("_row").distinct()
    return docs.withColumn("_row", row_hash(key, text, lang)).join(kept, "_row", "left_semi").select(*docs.columns)


def trusted_labels(labels: DataFrame) -> DataFrame:
    """Good documents; toxic ones do not train, but a limit of quality may not cost them more than others."""
    return labels.filter("quality = 1").select("doc_id", (F.coalesce("toxic", F.lit(0)) == 0).alias("trains"))
