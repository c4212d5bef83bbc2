"""Stateless text preparation on a Structured Streaming source.

The reference has no streams. Its per-row preparation (quote normalisation,
null coercion, fixed windows, token lengths, non-empty filters) is stateless,
so the same operators run unchanged on ``readStream`` input; new files are
prepared incrementally and exactly once through the sink's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import filters, textprep, tokens
from ..session import ensure_checkpoint_dir


def prepare_stream(spark: SparkSession, path: str, schema: str, text_col: str = "text", size: int = 1000,
                   glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream Parquet files from ``path`` and emit normalised ``size``-character chunks with token counts."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(path)
    d = textprep.coerce_text(src, [text_col])
    d = textprep.quotes(d, text_col)
    d = filters.non_empty(d, [text_col])
    c = textprep.chunk_text(d, text_col, size, out="chunk", pos="chunk_no")
    return c.withColumn("n_tokens", F.size(tokens.tokenize(F.col("chunk"))))


def start_prepared_stream(df: DataFrame, out_path: str, name: str = "prepared",
                          available_now: bool = True) -> StreamingQuery:
    """Write the prepared stream as Parquet; progress is checkpointed under the shared checkpoint folder."""
    ckpt = ensure_checkpoint_dir(df.sparkSession).rstrip("/") + f"/streams/{name}"
    w = df.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
