"""Extensions for streams: an index kept up to date, and the request log's latencies by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar.operators.index import upsert


def keep_index(changes: DataFrame, spark: SparkSession, path: str, checkpoint: str) -> StreamingQuery:
    """Upsert each batch of chunks (chunk_id, doc_id, ord, ...) into versions under `path`.

    A batch writes version `batch_id` from the one before and is idempotent: run again after a
    failure it writes the same version again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        target = f"{path}/version={batch_id}"
        if batch_id == 0:
            batch.write.mode("overwrite").parquet(target)
        else:
            old = spark.read.parquet(f"{path}/version={batch_id - 1}")
            upsert(old, batch).write.mode("overwrite").parquet(target)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency_by_window(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, mean and approximate percentiles of `value` for each window and type of `events` (ts, event_type, value); works on streams and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = marked.groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.percentile_approx("value", [0.5, 0.95], 10_000).alias("p")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95")
    )
