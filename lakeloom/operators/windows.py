"""Latest versions, snapshots, islands, deltas, positions and ordered folds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.lineage import cut


def latest(df: DataFrame, key: Sequence[str], *version: str) -> DataFrame:
    """The row of each key with the greatest version: an aggregation with partial maxima, not a sort of each group."""
    rest = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*version)).alias("_row")
    return df.groupBy(*key).agg(best).select(*key, "_row.*").select(*df.columns)


def as_of(df: DataFrame, key: Sequence[str], at: object, *version: str) -> DataFrame:
    """The latest row of each key whose first version column is at most `at`."""
    return latest(df.where(F.col(version[0]) <= F.lit(at)), key, *version)


def replayed(log: DataFrame, key: Sequence[str], lsn: str, op: str, deleted: str = "delete") -> DataFrame:
    """The image after redo of a change log: the record of greatest lsn wins whatever the order or repeats; deleted keys go."""
    return latest(log, key, lsn).where(F.col(op) != deleted)


def at_places(df: DataFrame, by: Sequence[str], order: Sequence[str], places: dict[str, Callable[[Column], Column]], weight: str | None = None) -> DataFrame:
    """(columns of df, _name): for each named place the row that holds it in its group's order; places count from 0 and are
    functions of the group's size. weight: a row stands for so many equal ones.

    No group is sorted in one task: rows are dealt out in ranges of (group, order), each range's part of a group is
    counted, and only the parts that hold a place are numbered.
    """
    own = F.col(weight) if weight else F.lit(1)
    ranged = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*by, "_part").agg(F.sum(own).alias("_rows"))
    of_group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = parts.withColumn("_from", before).withColumn("_n", F.sum("_rows").over(of_group))
    named = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("bigint").alias("at")) for name, place in places.items()])
    held = spread.withColumn("_held", F.filter(named, lambda x: (x["at"] >= F.col("_from")) & (x["at"] < F.col("_from") + F.col("_rows")))).where(F.size("_held") > 0)
    held = held.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), "_from", "_held")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(f"_g{i}").eqNullSafe(F.col(c))
    near = ranged.join(held, same)
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = near.withColumn("_end", F.col("_from") + F.sum(own).over(within))
    hit = placed.withColumn("_hit", F.filter("_held", lambda x: (x["at"] < F.col("_end")) & (x["at"] >= F.col("_end") - own)))
    return hit.where(F.size("_hit") > 0).select(*df.columns, F.explode("_hit.name").alias("_name"))


def numbered(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in one total order: ranges of the order are counted, and rows numbered in their range."""
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_rows"))
    # one row for each range: the only thing that one task sees whole
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.select(*df.columns, place.cast("bigint").alias(name))


def position_in_group(df: DataFrame, by: Sequence[str], order: Sequence[str], numerator: int, denominator: int) -> DataFrame:
    """The row at the 1-based position ceil(n * numerator / denominator) of each group."""
    return at_places(df, by, order, {"at": lambda n: F.ceil(n * numerator / denominator) - 1}).drop("_name")


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str], same: str) -> DataFrame:
    """(by..., same, island, accesses): maximal runs of successive rows with one value of `same`."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)), 0).otherwise(1)
    marked = df.withColumn("_new", change)
    run = marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, same, "island").agg(F.count("*").alias("accesses"))


def hold_statistics(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """holds, accesses, accesses_per_hold, max_accesses and reused_holds of each group of runs."""
    out = runs.groupBy(*by).agg(F.count("*").alias("holds"), F.sum("accesses").alias("accesses"), F.max("accesses").alias("max_accesses"), F.sum((F.col("accesses") > 1).cast("bigint")).alias("reused_holds"))
    return out.withColumn("accesses_per_hold", F.round(F.col("accesses") / F.col("holds"), 6))


def deltas(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """df with `delta`, the value's change from the row before; null on a group's first row."""
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def interior_window(df: DataFrame, by: str, ts: str) -> DataFrame:
    """(begin, end) of the time that all groups have in common: the latest start and the earliest end."""
    ends = df.groupBy(by).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    return ends.agg(F.max("a").alias("begin"), F.min("b").alias("end"))


def wall_ms(ts: str) -> Column:
    """Milliseconds since 1970 as the clock shows them, whatever the session's time zone (also for timestamps without one)."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date"))
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60000.0 + F.expr(f"extract(seconds from `{ts}`)").cast("double") * 1000


def ewma(df: DataFrame, by: Sequence[str], order: Sequence[str], ts_ms: str, value: str, alpha: float, ttl_ms: float) -> DataFrame:
    """(by..., samples, ewma): exponentially weighted mean in the given total order; a first sample, or one more than
    ttl_ms after the last, starts anew.

    As a weighted sum over the samples since the last start, from the latest back: running frames of one sort that may spill,
    and no array of a key's history.
    """
    back = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    at = F.col(ts_ms).cast("double")
    earlier = F.lead(at).over(back)
    starts = F.when((at >= earlier) & (at - earlier <= ttl_ms), 0).otherwise(1)
    rows = df.select(*by, *[c for c in dict.fromkeys(order) if c not in by], at.alias("_t"), F.col(value).cast("double").alias("_v"), starts.alias("_start"), F.row_number().over(back).alias("_back"))
    later = F.coalesce(F.sum("_start").over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weight = F.pow(F.lit(1 - alpha), F.col("_back") - 1) * F.when(F.col("_start") == 1, 1.0).otherwise(alpha)
    return rows.withColumn("_later", later).groupBy(*by).agg(F.count("*").alias("samples"), F.sum(F.when(F.col("_later") == 0, weight * F.col("_v"))).alias("ewma"))


def last_distinct(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """(by..., recent): the last `size` distinct values of each group, latest first."""
    seen = df.groupBy(*by, value).agg(F.max(F.struct(*order)).alias("_last"))
    ranked = seen.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_last"), value))).where(F.col("_at") <= size)
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("recent"))
