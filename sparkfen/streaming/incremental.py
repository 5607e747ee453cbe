"""Structured Streaming forms of what can be kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkfen.operators.timeline import merge_life


def event_windows(events: DataFrame, length: str = "1 hour", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) over event time; rows later than the watermark are dropped in a stream."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    a = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return a.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, session_start, n) by session windows."""
    a = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return a.select("user_id", F.col("w.start").alias("session_start"), "n")


def distinct_events(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events once each by event_id within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def keep_life(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps hash_life of a stream (min_hash, release_year) under path/v{batch}, from each batch and the version before.

    A batch that is run again writes the same version again, so a lost driver or executor does no harm.
    """

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("min_hash").agg(F.min("release_year").alias("birth_year"), F.max("release_year").alias("death_year"))
        out = new if number == 0 else merge_life(spark.read.parquet(f"{path}/v{number - 1}"), new)
        out.write.mode("overwrite").parquet(f"{path}/v{number}")

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
