"""Aggregations: grouped sums, guarded means, index-pick percentiles, roll-ups, windowed rates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.windows import at_places


def ratio_by(df: DataFrame, by: Sequence[str], good: Column) -> DataFrame:
    """attempts, commits and abort_ratio of each group; good marks what was committed."""
    out = df.groupBy(*by).agg(F.count("*").alias("attempts"), F.sum(good.cast("bigint")).alias("commits"))
    return out.withColumn("abort_ratio", F.round(1 - F.col("commits") / F.col("attempts"), 6))


def index_pick(df: DataFrame, by: Sequence[str], value: str, picks: dict[str, tuple[int, int]]) -> DataFrame:
    """Elements at the 0-based index floor(n * a / b) of each group's ascending values: no interpolation.

    picks: name -> (a, b). Equal values are counted first, so that frequent ones are one row.
    """
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_w"))
    found = at_places(counted, by, [value], {name: lambda n, a=a, b=b: F.floor(n * a / b) for name, (a, b) in picks.items()}, weight="_w")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in picks])


def guarded_sum(value: Column, expected: Column) -> Column:
    """The sum if every expected part has a value, else null: a missing part isn't zero."""
    return F.when(F.count(value) == expected, F.sum(value))


def weighted_mean(total: Column, count: Column) -> Column:
    """Sum of totals over sum of counts, null where nothing was counted."""
    return F.try_divide(F.sum(total), F.sum(count))


def rollup_matrix(df: DataFrame, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """A matrix with subtotals; `level` is the grouping id."""
    return df.rollup(*by).agg(*aggregates, F.grouping_id().cast("int").alias("level"))


def rate_by_window(df: DataFrame, ts: str, seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """(window_start, by..., events, per_second) in tumbling windows; windows without events have no row."""
    w = F.window(ts, f"{seconds} seconds").alias("w")
    out = df.groupBy(w, *by).agg(F.count("*").alias("events"))
    return out.select(F.col("w.start").alias("window_start"), *by, "events", (F.col("events") / seconds).alias("per_second"))


def rate_in_bounds(df: DataFrame, ts: str, start: str, deadline: str) -> DataFrame:
    """events and per_second in [start, deadline): what drains after the deadline doesn't count."""
    kind = df.schema[ts].dataType
    inside = (F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(deadline).cast(kind))
    seconds = (datetime.fromisoformat(deadline) - datetime.fromisoformat(start)).total_seconds()
    return df.where(inside).agg(F.count("*").alias("events")).withColumn("per_second", F.col("events") / seconds)


def with_idle_windows(rates: DataFrame, seconds: int) -> DataFrame:
    """Windows from first to last, those without events at 0: the spine is a sequence, not a join of all pairs."""
    ends = rates.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).where("a is not null")
    spine = ends.select(F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("window_start"))
    return spine.join(rates, "window_start", "left").fillna(0)


def hot_ratio(df: DataFrame, key: str, hot: int) -> DataFrame:
    """(hot_events, total_events, ratio): the share of rows on the `hot` most frequent keys, ties to the smaller key."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(hot)
    both = top.agg(F.sum("n").alias("hot_events")), counts.agg(F.sum("n").alias("total_events"))
    one = both[0].withColumn("_k", F.lit(1)).join(both[1].withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumn("ratio", F.round(F.col("hot_events") / F.col("total_events"), 6))


def deduped_flags(df: DataFrame, by: Sequence[str], flag: str) -> DataFrame:
    """One row for each key with the flag of any of its rows."""
    return df.groupBy(*by).agg(F.bool_or(flag).alias(flag), F.count("*").alias("accesses"))


def merged_rows(df: DataFrame, by: Sequence[str], counters: Sequence[str]) -> DataFrame:
    """Additive counters summed over parts."""
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters])


def flushes(records: DataFrame, by: Sequence[str], ts: str, interval: str, trigger: int) -> DataFrame:
    """(by..., records, batches, records_per_batch) of group commit: a batch goes out with its `trigger`-th record, and with
    the end of an interval that has records."""
    ticks = records.groupBy(*by, F.window(ts, interval).alias("w")).agg(F.count("*").alias("records"))
    ticks = ticks.withColumn("batches", F.ceil(F.col("records") / trigger))
    return merged_rows(ticks, by, ["records", "batches"]).withColumn("records_per_batch", F.round(F.col("records") / F.col("batches"), 6))
