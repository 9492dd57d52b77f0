"""The request path as a stream: the same row-local jobs on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from redpen.operators.features import PieceVocabulary
from redpen.operators.predict import (
    Predictor, attach_quality_label, clean_predictions, predict_table, prepare_inputs,
)


def answer_requests(
    requests: DataFrame,
    tagger: Callable[[], Predictor],
    classifier: Callable[[], Predictor],
    vocab: PieceVocabulary,
    label_map: DataFrame,
    max_len: int,
) -> DataFrame:
    """``row_id, prediction, quality`` for a stream of ``row_id, source``; no state is kept."""
    inputs = prepare_inputs(requests.select("row_id", "source"), with_target=False)
    rows = inputs.select("row_id", F.array("source").alias("sources"), "target")
    predicted = predict_table(rows, tagger, vocab, label_map, max_len)
    labelled = attach_quality_label(predicted, classifier, vocab, max_len)
    return clean_predictions(labelled).select("row_id", "prediction", "quality")
