"""Micro-batch adapters (Structured Streaming)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def row_local(stream: DataFrame, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a row-local operator (e.g. ``strip_markdown``) to a streaming frame;
    it is the same plan Spark would run in batch, one micro-batch at a time."""
    if not stream.isStreaming:
        raise ValueError("expects a streaming DataFrame")
    return op(stream)


def profile_each_batch(stream: DataFrame, op: Callable[[DataFrame], DataFrame], sink_path: str,
                       query_name: str, available_now: bool = True, checkpoint: str | None = None):
    """Run a batch operator (e.g. ``missing_profile``) on every micro-batch and
    append its rows, tagged with the batch id, as parquet under ``sink_path``.
    Progress lives in the shared checkpoint folder, so a restarted query resumes
    at the first unfinished batch."""
    spark = stream.sparkSession
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/stream-{query_name}"

    def each(batch: DataFrame, batch_id: int) -> None:
        op(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink_path)

    w = stream.writeStream.queryName(query_name).option("checkpointLocation", ckpt).foreachBatch(each)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
