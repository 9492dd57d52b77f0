"""Batch prediction: inputs, a pluggable predictor inside the tasks, realised texts, wide tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from redpen.functions import text
from redpen.functions.kernels import repair_udf
from redpen.operators.features import PieceVocabulary, edit_features, feature_tokens, grammar_features, token_labels
from redpen.operators.lookup import Lookup
from redpen.operators.pairs import clean_text, drop_empty_pairs
from redpen.operators.ranking import union_all
from redpen.operators.tagging import apply_infeasible_policy, realize

# A predictor takes a frame with input_ids, input_mask and segment_ids, and returns one
# list of label ids per row. The factory runs once per task.
Predictor = Callable[[pd.DataFrame], list]


def prepare_inputs(df: DataFrame, with_target: bool) -> DataFrame:
    """Clean and space the texts and drop empty rows; without targets the source stands in."""
    if with_target and "target" not in df.columns:
        raise ValueError("scoring needs a target column")
    if not with_target:
        df = df.withColumn("target", F.col("source"))
    kept = drop_empty_pairs(clean_text(df, ["source", "target"]))
    spaced = kept.withColumns({c: text.treebank(F.col(c)) for c in ("source", "target")})
    return drop_empty_pairs(spaced)


INPUTS = ["input_ids", "input_mask", "segment_ids"]


def _predicted(factory: Callable[[], Predictor], kind: str, batch: int) -> Column:
    """The predictor's answer per row; only the three id lists travel to the Python side.

    Marked as not deterministic: the optimiser would otherwise copy the call into every use of its answer.
    """

    @F.pandas_udf(kind)
    def predict(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for columns in frames:
            frame = pd.concat(columns, axis=1, keys=INPUTS)
            parts = [model(frame.iloc[at : at + batch]) for at in range(0, len(frame), batch)]
            yield pd.Series([answer for part in parts for answer in part], dtype=object)

    return predict.asNondeterministic()(*INPUTS)


def predict_table(
    df: DataFrame,
    factory: Callable[[], Predictor],
    vocab: PieceVocabulary,
    label_map: DataFrame,
    max_len: int,
    key: str = "row_id",
    batch: int = 64,
    embedding: str = "normal",
) -> DataFrame:
    """``key, sources, target, prediction``: features, predicted labels, realised text.

    Labels missing for cut tokens mean KEEP.
    """
    keep_id = label_map.filter("tag = 'KEEP'").first()["tag_id"]
    by_id = Lookup(label_map, "tag_id", "tag", default="")
    tagged = apply_infeasible_policy(feature_tokens(df), "predict")
    rows = edit_features(tagged, vocab, label_map, max_len, embedding, (key, "sources", "target"), ("row_starts",))
    scored = rows.withColumn("pred", _predicted(factory, "array<int>", batch))
    inner = lambda at: (at > 0) & (at < F.size("pred") - 1)
    labels = token_labels(F.col("pred"), inner, F.col("token_starts"), keep_id)
    return realize(by_id.add(scored, "tags", labels), out="prediction").select(
        key, "sources", "target", "prediction"
    )


def attach_quality_label(
    df: DataFrame,
    factory: Callable[[], Predictor],
    vocab: PieceVocabulary,
    max_len: int,
    col: str = "prediction",
    out: str = "quality",
    batch: int = 64,
) -> DataFrame:
    """Run a classifier over the texts of ``col`` and add its label."""
    rows = grammar_features(df, vocab, max_len, col)
    return rows.withColumn(out, _predicted(factory, "int", batch)).drop(*INPUTS)


def clean_predictions(df: DataFrame, col: str = "prediction", out: str = "prediction") -> DataFrame:
    """Remove stray marks and detokenise."""
    return df.withColumn("_r", repair_udf()(text.tokens(F.col(col)))).withColumn(
        out, text.detokenised(F.col("_r"))
    ).drop("_r")


def multi_model_table(
    predictions: dict[str, DataFrame], key: str = "row_id", with_target: bool = True
) -> DataFrame:
    """One row per input with a repaired prediction per model, joined by key.

    The frames are united and folded by one aggregation; only the first model's rows carry
    source and target, so those are shuffled once however many models there are.
    """
    models = list(predictions)

    def side(m: str, df: DataFrame) -> DataFrame:
        texts = [F.col(c) if m == models[0] else F.lit(None).cast("string").alias(c) for c in ("source", "target")]
        return clean_predictions(df).select(key, *texts, "prediction", F.lit(m).alias("model"))

    long = union_all([side(m, df) for m, df in predictions.items()])
    answers = [F.first(F.when(F.col("model") == m, F.col("prediction")), True).alias(m) for m in models]
    first = F.col("model") == models[0]
    original = F.first(F.when(first, F.col("source")), True).alias("original")
    target = [F.first(F.when(first, F.col("target")), True).alias("target")] if with_target else []
    return long.groupBy(key).agg(original, *answers, *target)
