"""File changes as a stream: the batch algebra, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WATERMARK = "10 minutes"


def latest_changes(events: DataFrame) -> DataFrame:
    """The latest event a path of (path, content, ts, op); ties by op, content."""
    latest = events.groupBy("path").agg(F.max_by(F.struct("content", "op"), F.struct("ts", "op", "content")).alias("e"), F.max("ts").alias("ts"))
    return latest.select("path", F.col("e.content").alias("content"), F.col("e.op").alias("op"), "ts")


def without_late(changes: DataFrame, stored: DataFrame) -> DataFrame:
    """Changes newer than what is stored of their path (path, last_indexed)."""
    joined = changes.join(stored.select("path", "last_indexed"), "path", "left")
    return joined.where(F.col("last_indexed").isNull() | (F.col("ts") > F.col("last_indexed"))).select(*changes.columns)


def follow(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, stored: Callable[[], DataFrame] | None = None) -> StreamingQuery:
    """Run ``apply(changes, batch id)`` on each micro-batch of a stream of events,
    without changes older than ``stored()`` (path, last_indexed), if given.
    ``apply`` must be idempotent for a batch id, as a batch may run again."""
    watched = events.withWatermark("ts", WATERMARK)

    def batch(df: DataFrame, number: int) -> None:
        changes = latest_changes(df)
        apply(without_late(changes, stored()) if stored else changes, number)

    return watched.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Windowed counts a type.  In update or append mode events past the watermark
    are dropped and the state of closed windows is freed; complete mode keeps all."""
    return events.withWatermark("ts", WATERMARK).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
