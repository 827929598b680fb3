"""Streams: windows over events, and pair scoring against static profiles."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream gets a watermark, on a time that counts from the epoch."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed(events: DataFrame, late: str = "1 hour", size: str = "1 day", slide: str | None = None, time: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of events per window; runs on streams and tables alike."""
    events = _timed(events, time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return events.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Events of a user joined into sessions that a gap ends."""
    events = _timed(events, time, late)
    return events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def score_stream(pairs: DataFrame, profiles: DataFrame, score) -> DataFrame:
    """Pairs of a stream scored by a static table of profiles: two left joins and a function of Columns, without state."""
    side = lambda s: profiles.select(F.col("id").alias(s), F.struct(*[c for c in profiles.columns if c != "id"]).alias(f"p{s}"))
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select(*pairs.columns, score.alias("score"))
