"""Commit rates over event time: tumbling windows with a watermark, and the rows that come too late."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(events: DataFrame, ts: str, seconds: int = 2, by: Sequence[str] = (), lateness: str = "10 seconds", committed: str | None = None) -> DataFrame:
    """(window_start, by..., events, per_second) of a stream or a table; windows close once the watermark passes them."""
    rows = events.where(committed) if committed else events
    rows = rows.withWatermark(ts, lateness)
    out = rows.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), *by, "events", (F.col("events") / seconds).alias("per_second"))


def split_by_deadline(events: DataFrame, ts: str, deadline: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the measurement window, rows that drain after it)."""
    end = F.lit(deadline).cast(events.schema[ts].dataType)
    return events.where(F.col(ts) < end), events.where(F.col(ts) >= end)
