"""Event-time windows and stateful deduplication over a stream or table of events.

Each function takes a DataFrame with an event-time column and works on batch and stream alike; on a
stream the watermark bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _late(df: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Watermark on a stream; time stamps without a zone become UTC instants first, as watermarks need."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, lateness) if df.isStreaming else df


def tumbling(df: DataFrame, size: str = "1 day", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    w = F.window(ts, size)
    return _late(df, ts, lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, size: str = "2 days", slide: str = "1 day", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    w = F.window(ts, size, slide)
    return _late(df, ts, lateness).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(df: DataFrame, gap: str = "6 hours", key: str = "user_id", ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    w = F.session_window(ts, gap)
    return _late(df, ts, lateness).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_seen(df: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """Each key once: the earliest row of a table, the first to arrive of a stream."""
    if df.isStreaming:
        return _late(df, ts, lateness).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("s")).select(*keys, "s.*")


def foreach_upsert(stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None]):
    """Run an upsert per micro-batch; ``apply`` must be idempotent for a batch number."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
