"""Streams: deduplicated timed news, counts by window, as-of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "3 days") -> DataFrame:
    """A stream without repeats of keys within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def counts(stream: DataFrame, time: str, by: str, every: str = "1 day", late: str = "3 days") -> DataFrame:
    """Counts by tumbling window and key; late rows count until the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select("w.start", by, "n")


def to_sessions(batch: DataFrame, calendar: DataFrame, time: str) -> DataFrame:
    """A micro-batch with its strict next session: for foreachBatch against a static calendar."""
    from newstide.operators.asof import forward_asof

    return forward_asof(batch.withColumn("_day_of", F.to_date(time)), calendar, "_day_of", "session", strict=True).drop("_day_of")
