"""Soft-membership mixing, in DataFrame operations only.

A naive Bayes classifier is fitted on a labelled table and gives every document a posterior
over the domains. Nonnegative rates per document are then found by projected-gradient least
squares, so that the expected tokens of each domain, the sum of rate * tokens * posterior, meet the targets.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions.hashing import uniform
from redpen.functions.text import let
from redpen.session import stage

BUCKETS = 1 << 16  # hashed words; fixes the size of the classifier
LABELLED = 20_000  # labelled rows that the classifier is fitted on, chosen by a hash
SMOOTHING = 10.0  # documents of average content that each domain is given
SIGNIFICANT = 6.0  # standard errors by which a word must differ between domains to count
VARIED = 20  # words from which on a document's variety counts
STEPS = 40
RIDGE = 1e-3  # weight of the distance of rates from one against the errors
CLOSE = 1e-6  # gradient, relative to the largest target, at which the fit ends

WORD_BREAK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between ASCII spaces; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def feature(word: Column) -> Column:
    """A word of letters in lower case; of any other word its shape, with runs of letters and digits as one sign."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(word, r"\p{Ll}+", "a"), r"\p{Lu}+", "A"), r"\p{N}+", "0")
    return F.when(word.rlike(r"^[\p{L}.,]+$"), F.lower(word)).otherwise(shape)


def features(words_: Column) -> Column:
    """The different features of a document, and how varied it is: the tenths that different ones make up of its words.

    A word that is repeated a thousand times says no more than once; that it is repeated tells something of its own.
    """
    def varied(different: Column) -> Column:
        tenths = F.concat(F.lit("different/10: "), F.floor(F.size(different) * 10 / F.greatest(F.size(words_), F.lit(1))).cast("string"))
        return F.concat(different, F.filter(F.array(tenths), lambda x: F.size(words_) >= VARIED))

    return let(F.array_distinct(F.transform(words_, feature)), varied)


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def fit_classifier(docs: DataFrame, labelled: DataFrame, key: str, text: str, domain: str, domains: list[str], bound: int | None = LABELLED) -> tuple[DataFrame, list[float]]:
    """(weights, priors): log chances of a bucket in a document of each domain, and the log share of each domain.

    Fitted on at most ``bound`` labelled rows, taken in the order of a hash of their ids, or on all (None). Words whose counts do
    not differ significantly between the domains have no weight. The table has at most BUCKETS rows.
    """
    known = labelled.filter(F.col(domain).isin(domains) & F.col(key).isNotNull()).groupBy(key).agg(F.min(domain).alias("_domain"))
    sample = known if bound is None else F.broadcast(known.orderBy(F.xxhash64(key), key).limit(bound))  # at most ``bound`` small rows
    taught = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(sample.select(F.col(key).alias("_key"), "_domain"), "_key")
    counted = taught.select("_domain", F.explode(features(words(F.col("_text")))).alias("w")).groupBy(bucket(F.col("w")).alias("bucket")).agg(
        *[F.count_if(F.col("_domain") == d).alias(f"n{i}") for i, d in enumerate(domains)]
    )
    counted = stage(counted, "bucket-counts")
    sizes = dict(taught.groupBy("_domain").count().collect())
    rows = [float(sizes.get(d, 0)) for d in domains]
    every = max(sum(rows), 1.0)
    priors = [float(np.log((r + 1.0) / (sum(rows) + len(rows)))) for r in rows]
    n = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    gaps = [F.abs(F.col(f"n{i}") - n * (r / every)) / F.sqrt(n * (r / every) + F.lit(1.0)) for i, r in enumerate(rows)]
    gap = F.greatest(*gaps) if len(gaps) > 1 else gaps[0]
    # the share of documents with the word, smoothed towards its share in all domains
    logs = [F.log((F.col(f"n{i}") + SMOOTHING * n / every) / (r + SMOOTHING)) for i, r in enumerate(rows)]
    weights = counted.filter(gap > SIGNIFICANT).select("bucket", *[x.alias(f"w{i}") for i, x in enumerate(logs)])
    return stage(weights, "bucket-weights"), priors


def posteriors(docs: DataFrame, key: str, text: str, weights: DataFrame, priors: list[float], *others: str) -> DataFrame:
    """``key, others, text_hash, n_tokens, p`` (array by domain): one row per input row.

    The different words of a document meet the weights (at most BUCKETS rows, broadcast) where they lie; only sums move.
    Documents without words have the prior.
    """
    k = len(priors)
    own = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key), *others, F.xxhash64(text).alias("text_hash"), words(F.col(text)).alias("_words")
    ).withColumn("n_tokens", F.size("_words").cast("long"))
    at = own.select("_row", key, *others, "text_hash", "n_tokens", F.explode_outer(features(F.col("_words"))).alias("w")).withColumn("bucket", bucket(F.col("w")))
    met = at.join(F.broadcast(weights), "bucket", "left")
    sums = met.groupBy("_row", key, *others, "text_hash", "n_tokens").agg(
        *[F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(k)]
    )
    logits = [F.col(f"s{i}") + priors[i] for i in range(k)]
    top = F.greatest(*logits) if k > 1 else logits[0]
    raised = [F.exp(x - top) for x in logits]
    whole = sum(raised[1:], raised[0])
    return sums.select(key, *others, "text_hash", "n_tokens", F.array(*[x / whole for x in raised]).alias("p"))


def rate_of(gains: list[float]) -> Column:
    """max(0, 1 + posterior * gains): the projection of a start of one plus all gradient steps so far.

    A step moves every document along its posterior, so one gain per domain holds all steps
    and no rate is ever stored or joined.
    """
    return F.greatest(F.lit(0.0), sum((F.col("p")[i] * g for i, g in enumerate(gains)), F.lit(1.0)))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[Column, list[float]]:
    """(rate column, expected tokens by domain): ``members`` has ``n_tokens`` and ``p``.

    Projected-gradient least squares over rates >= 0: the squared error of each domain divided by its target, plus a
    small RIDGE times the squared distance of the rates from one, weighted by tokens. So rates stay near one where the
    targets allow it, and a target that cannot be met is met as nearly as possible. The gradient
    has one number per domain; a step is scaled by the curvature of the documents whose rate is
    above zero and halved while the gradient does not shrink. Every step is one pass that returns some sums.
    """
    k = len(targets)
    tokens = F.col("n_tokens").cast("double")
    goal = np.array(targets, float)
    unit = RIDGE * np.maximum(goal, max(goal.max(initial=0.0), 1.0) * 1e-3)

    def look(gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rate = rate_of(gains.tolist())
        moving = F.when(rate > 0, tokens).otherwise(0.0)
        pairs = [F.sum(moving * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]
        row = members.agg(*[F.sum(rate * tokens * F.col("p")[i]) for i in range(k)], *pairs).first()
        sums = np.array([x or 0.0 for x in row], float)
        return goal - sums[:k] - unit * gains, sums[k:].reshape(k, k), sums[:k]

    gains = np.zeros(k)
    slope, curve, held = look(gains)
    for _ in range(steps):
        if np.abs(slope).max(initial=0.0) <= CLOSE * max(goal.max(initial=0.0), 1.0):
            break
        move = np.linalg.solve(curve + np.diag(unit), slope)
        after = look(gains + move)
        while np.square(after[0]).sum() > np.square(slope).sum() and np.abs(move).max() > 1e-9:
            move = move / 2
            after = look(gains + move)
        gains = gains + move
        slope, curve, held = after
    return rate_of(gains.tolist()), held.tolist()


def copies(rate: Column, seed: int, *parts: Column) -> Column:
    """Whole copies with the rate as expectation; chance is a hash of the parts."""
    return (F.floor(rate) + (uniform(seed, *parts) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_sources(
    docs: DataFrame, labelled: DataFrame, key: str, text: str, domain: str, shares: dict[str, float], others: tuple[str, ...] = (),
    total: float | None = None, bound: int | None = LABELLED, seed: int = 0,
) -> DataFrame:
    """``key, others, text_hash, n_tokens, p_<domain>, rate, copies``: one row per input row.

    ``shares`` are the target weights of the domains of ``labelled.domain``; they are scaled to ``total`` tokens, by default all there are.
    Documents without words have posterior and rate but no tokens. Null ids are rated too; repeated rows with the same
    id and text get the same number of copies. A domain without labelled rows has only its prior. An empty table gives no rows.
    """
    domains = list(shares)
    weights, priors = fit_classifier(docs, labelled, key, text, domain, domains, bound)
    members = stage(posteriors(docs, key, text, weights, priors, *others), "posteriors")
    if total is None:
        total = float(members.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    whole = sum(shares.values()) or 1.0
    rate, _ = fit_rates(members, [shares[d] / whole * total for d in domains])
    rated = members.withColumn("rate", rate)
    return rated.select(
        key, *others, "text_hash", "n_tokens", *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(domains)], "rate",
        copies(F.col("rate"), seed, F.col(key), F.col("text_hash")).alias("copies"),
    )


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: toxic documents, poor ones among the rest, and clean ones; rows without a mark are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")
