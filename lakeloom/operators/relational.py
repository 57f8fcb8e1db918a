"""Scan, filter, projection, joins, order and top-k over DataFrames: plans are declared, Catalyst picks the strategy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (left column, operator, right): right is a Column, or a literal.
Condition = tuple[str, str, Any]
_OPS = {"=": "__eq__", "<>": "__ne__", "<": "__lt__", ">": "__gt__", "<=": "__le__", ">=": "__ge__"}


def comparison(left: Column, op: str, right: Column) -> Column:
    return getattr(left, _OPS[op])(right)


def condition(spec: Condition) -> Column:
    left, op, right = spec
    return comparison(F.col(left), op, right if isinstance(right, Column) else F.lit(right))


def conjunction(specs: Sequence[Condition]) -> Column:
    return reduce(lambda a, b: a & b, map(condition, specs), F.lit(True))


def select_where(df: DataFrame, specs: Sequence[Condition]) -> DataFrame:
    """Rows for which all conditions hold; over a Parquet scan they become pushed filters."""
    return df.where(conjunction(specs)) if specs else df


def point_lookup(df: DataFrame, key: str, value: Any, residual: Sequence[Condition] = ()) -> DataFrame:
    """Rows with one key, residual predicates included; row-group statistics prune the scan."""
    return select_where(df, [(key, "=", value), *residual])


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Columns in the given order; a pair is (column, new name), so a column may come twice."""
    return df.select(*[F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns])


def join_on(left: DataFrame, right: DataFrame, specs: Sequence[Condition]) -> DataFrame:
    """Inner join on a conjunction of equality and other comparisons between the sides; none of them: all pairs."""
    if not specs:
        return left.crossJoin(right)
    return left.join(right, conjunction([(a, op, F.col(b)) for a, op, b in specs]), "inner")


def lookup_found(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows of keys that the table has."""
    return keys.join(table.select(on), on, "left_semi")


def lookup_missing(keys: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Rows of keys that the table lacks."""
    return keys.join(table.select(on), on, "left_anti")


def lookup(ops: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """ops with the table's columns and a flag `found`; a missing key keeps its row."""
    marked = table.withColumn("found", F.lit(True))
    return ops.join(marked, on, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ordered(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc() if descending else F.col(column).asc())


def bulk_sorted(df: DataFrame, *key: str, partitions: int | None = None) -> DataFrame:
    """Rows in ranges of the key, sorted within each: the layout of a bulk-loaded index, whose files' statistics prune look-ups."""
    ranged = df.repartitionByRange(partitions, *key) if partitions else df.repartitionByRange(*key)
    return ranged.sortWithinPartitions(*key)


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows by the given order: each task keeps k rows, no total sort."""
    return df.orderBy(*order).limit(k)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are equal as multisets."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
