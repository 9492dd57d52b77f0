"""Scores of predictions: exact match, SARI, accuracies and class reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import text
from redpen.functions.kernels import sari_udf
from redpen.operators.ranking import running_total

def lowercase_columns(df: DataFrame) -> DataFrame:
    """Lower-case source, prediction (or ``predictions``) and targets for case-insensitive scores."""
    low = {"source": F.lower("source"), "targets": F.transform("targets", F.lower)}
    if "predictions" in df.columns:
        low["predictions"] = F.transform(
            "predictions", lambda x: F.struct(x["model"].alias("model"), F.lower(x["prediction"]).alias("prediction"))
        )
    else:
        low["prediction"] = F.lower("prediction")
    return df.withColumns(low)


def exact_score(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of predictions equal to any target; 0 without rows."""
    hit = F.avg(F.array_contains("targets", F.col("prediction")).cast("double"))
    return df.groupBy(*(by or [])).agg(F.coalesce(hit, F.lit(0.0)).alias("exact"))


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(
        (precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)
    ).otherwise(F.lit(0.0))


def sari_rows(df: DataFrame, keep: list[str], strip: bool = True) -> DataFrame:
    """``keep columns, sari, keep, addition, deletion`` per row of source, prediction, targets.

    With a list ``predictions`` of structs ``model, prediction`` instead of one prediction there is one row per
    entry, and the grams of source and targets are made once for all of them; ``keep`` may then name ``model`` and
    ``exact``, whether the prediction is one of the targets.

    Everything is set arithmetic inside the row (``kernels.sari_scores``).
    """
    prepare = text.strip_separators if strip else (lambda c: c)
    many = "predictions" in df.columns
    listed = F.transform("predictions", lambda x: prepare(x["prediction"])) if many else F.array(prepare(F.col("prediction")))
    step = df.withColumn("_scores", sari_udf()(prepare(F.col("source")), F.transform("targets", prepare), listed))
    if many:
        step = step.withColumn("_at", F.explode(F.arrays_zip(F.col("predictions").alias("one"), F.col("_scores").alias("score"))))
        exact = F.array_contains("targets", F.col("_at.one.prediction")).cast("double")
        step = step.withColumns({"model": F.col("_at.one.model"), "exact": exact, "_score": F.col("_at.score")})
    else:
        step = step.withColumn("_score", F.get("_scores", F.lit(0)))
    scored = step.select(*keep, *[F.col(f"_score.{c}").alias(c) for c in ("keep", "addition", "deletion")])
    return scored.withColumn("sari", (F.col("keep") + F.col("addition") + F.col("deletion")) / 3.0)


def score_report(df: DataFrame, by: str = "model") -> DataFrame:
    """Per model: exact, SARI and its parts as percentages, in one aggregation.

    Takes one prediction per row, or a list ``predictions`` per input.
    """
    if "predictions" not in df.columns:
        df = df.withColumn("exact", F.array_contains("targets", F.col("prediction")).cast("double"))
    rows = sari_rows(df, [by, "exact"])
    names = ["exact", "sari", "keep", "addition", "deletion"]
    return rows.groupBy(by).agg(*[F.round(F.avg(c) * 100, 3).alias(c) for c in names])


def sequence_accuracy(df: DataFrame, labels: str, predicted: str, mask: str, loss: str) -> DataFrame:
    """Share of rows whose unmasked labels are all right, with the mean loss."""
    right = F.forall(
        F.arrays_zip(F.col(labels).alias("l"), F.col(predicted).alias("p"), F.col(mask).alias("m")),
        lambda x: (x["m"] == 0) | (x["l"] == x["p"]),
    )
    return df.agg(
        F.avg(right.cast("double")).alias("accuracy"), F.avg(loss).alias("loss")
    )


def weighted_token_accuracy(df: DataFrame, labels: str, predicted: str, weights: str, losses: str) -> DataFrame:
    """Accuracy and loss over masked positions, weighted; positions are folded inside the row."""
    zipped = F.arrays_zip(
        F.col(labels).alias("l"), F.col(predicted).alias("p"), F.col(weights).alias("w"), F.col(losses).alias("x")
    )

    def total(value) -> Column:
        return F.sum(F.aggregate(zipped, F.lit(0.0), lambda acc, e: acc + value(e).cast("double")))

    weight = total(lambda e: e["w"])
    return df.agg(
        (total(lambda e: F.when(e["l"] == e["p"], e["w"]).otherwise(0.0)) / weight).alias("accuracy"),
        (total(lambda e: e["w"] * e["x"]) / weight).alias("loss"),
        weight.alias("weight"),
    )


def arg_max(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def example_accuracy(df: DataFrame, scores: str, label: str, loss: str, weight: str = "is_real_example") -> DataFrame:
    """Accuracy of the arg-max class and mean loss over real rows."""
    w = F.col(weight).cast("double")
    hit = (arg_max(F.col(scores)) == F.col(label)).cast("double")
    return df.agg((F.sum(hit * w) / F.sum(w)).alias("accuracy"), (F.sum(F.col(loss) * w) / F.sum(w)).alias("loss"))


def class_report(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    """Per class found in the targets: support, precision, recall and F1; 0 without a hit.

    Rows are first counted per (target, prediction); the rest reads that small table.
    """
    cells = df.groupBy(F.col(target).alias("t"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    relevant = cells.groupBy(F.col("t").alias("class")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"),
    )
    selected = cells.groupBy(F.col("p").alias("class")).agg(F.sum("n").alias("selected"))
    hit = F.col("tp") > 0
    return (
        relevant.join(selected, "class", "left")
        .withColumns({
            "precision": F.when(hit, F.col("tp") / F.col("selected")).otherwise(0.0),
            "recall": F.when(hit, F.col("tp") / F.col("support")).otherwise(0.0),
        })
        .select("class", "support", "precision", "recall", _f1(F.col("precision"), F.col("recall")).alias("f1"))
    )


def accuracy(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(target)).cast("double")).alias("accuracy"))


def binary_metrics(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Counts of the confusion table with accuracy, precision, recall and F1 for labels 0/1."""
    p, t = F.col(prediction) == 1, F.col(target) == 1
    counts = df.agg(
        F.count_if(p & t).alias("tp"), F.count_if(~p & ~t).alias("tn"),
        F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    total = tp + F.col("tn") + fp + fn
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return counts.select(
        "*",
        ((tp + F.col("tn")) / total).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(tp > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
    )


def roc_auc(df: DataFrame, score: str, target: str) -> DataFrame:
    """Area under the curve: share of (positive, negative) pairs in the right order, ties one half.

    Rows are counted per distinct score first; the negatives below each score come from a
    running total over quantile slices, never from one global sort.
    """
    per_score = df.groupBy(score).agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg")
    )
    below = running_total(per_score, score, "neg", "below")
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return below.agg((won / (F.sum("pos").cast("double") * F.sum("neg"))).alias("auc"))
