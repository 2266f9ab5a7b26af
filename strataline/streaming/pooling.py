"""Pooling without end: the sums of the cohort ladder can be kept up to date, and pages idle by sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.functions.core import finite, key_or_unknown, safe_div


def running_pool(stream: DataFrame, by: list[str], sums: list[str], ratios: dict[str, tuple[str, str]]) -> DataFrame:
    """Sums and their ratios over all rows so far (update or complete mode): state is one row a group."""
    keyed = stream.withColumns({k: key_or_unknown(k) for k in by})
    made = keyed.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(finite(c)).alias(c) for c in sums])
    return made.withColumns({k: safe_div(a, b) for k, (a, b) in ratios.items()})


def windowed_pool(stream: DataFrame, at: str, by: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count, sum and mean by event-time window; rows later than the watermark are left out, so state stays bounded."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"), F.sum(finite(value)).alias("total"))
    return w.select(F.col("window.start").alias("start"), *by, "n", "total", safe_div("total", F.col("n").cast("double")).alias("mean"))


def idle_sessions(stream: DataFrame, at: str, key: str, gap: str = "10 seconds", late: str = "10 seconds") -> DataFrame:
    """Spans of activity of each key that a gap ends."""
    s = stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
