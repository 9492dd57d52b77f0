"""All registered queries: name -> (Spark function, SQL for the check or None)."""

from __future__ import annotations

from redpen.plans import edit_queries, feature_queries, file_queries, pair_queries, predict_queries, score_queries, span_queries, stream_queries

CATALOG = {
    **pair_queries.QUERIES,
    **edit_queries.QUERIES,
    **feature_queries.QUERIES,
    **span_queries.QUERIES,
    **predict_queries.QUERIES,
    **score_queries.QUERIES,
    **file_queries.QUERIES,
    **stream_queries.QUERIES,
}
