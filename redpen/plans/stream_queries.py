"""Row-local jobs on streams of files: the same functions, the same answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from redpen.functions import text
from redpen.operators import pairs, predict, tagging
from redpen.plans import edit_queries as e, pair_queries as p, predict_queries as q, views as v
from redpen.session import staged_path


def streamed(spark: SparkSession, rows: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What ``work`` gives for ``rows`` when they come as a stream of files.

    Half of the rows are there when the stream starts. It ends when it has caught up, the other half arrives, and a second run goes on from
    the checkpoint, which lies in the shared folder next to the sink.
    """
    folder = staged_path(spark, name)
    for half in (0, 1):
        arriving = rows.filter(F.pmod(F.xxhash64(*key), F.lit(2)) == half)
        arriving.write.mode("append").parquet(f"{folder}/in")
        done = work(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in"))
        sink = done.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
        sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/out")


def stream_prepare_inputs(spark, sf):
    """Cleaned and spaced texts without empty rows."""
    rows = v.chat_pairs(spark, sf)
    done = streamed(spark, rows, ["conv_id", "turn"], lambda df: predict.prepare_inputs(df, True), "stream-prepare")
    return done.select("conv_id", "turn", "source", "target")


def stream_mask_tokens(spark, sf):
    rows = v.lines(spark, sf).select("pair_id", F.col("toks").alias("pieces"))
    done = streamed(spark, rows, ["pair_id"], pairs.mask_tokens, "stream-mask")
    return done.select("pair_id", text.spaced(F.col("pieces")).alias("masked"))


def stream_realize(spark, sf):
    rows = e.generated_tags(spark, sf).select("pair_id", "sources", "tags")
    return streamed(spark, rows, ["pair_id"], tagging.realize, "stream-realize").select("pair_id", "realized")


QUERIES = {
    "stream_prepare_inputs": (stream_prepare_inputs, q.PREPARE),
    "stream_mask_tokens": (stream_mask_tokens, p.MASK_TOKENS),
    "stream_realize": (stream_realize, e.REALIZE),
}
