"""Interactive transaction lines and key-value transactions as set operations.

A line is `tid,key,is_write[,value]` operations separated by semicolons; a value may hold commas.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_line(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines' columns with op_seq, table_id, item_key, is_write and value (null without one), a row for each operation."""
    rest = [c for c in lines.columns if c != line]
    ops = lines.select(*rest, F.posexplode(F.split(line, ";")).alias("op_seq", "op")).withColumn("op", F.trim("op")).where("op <> ''")
    parts = F.split("op", ",", 4)
    number = lambda i, kind: F.expr(f"try_cast(trim(get(split(op, ',', 4), {i})) as {kind})")
    return ops.select(*rest, F.col("op_seq").cast("bigint").alias("op_seq"), number(0, "bigint").alias("table_id"), number(1, "bigint").alias("item_key"), (number(2, "int") != 0).alias("is_write"), F.get(parts, 3).alias("value"))


def summary(ops: DataFrame, txn: str) -> DataFrame:
    """(txn, reads, writes, reply) of each transaction."""
    out = ops.groupBy(txn).agg(F.sum((~F.col("is_write")).cast("bigint")).alias("reads"), F.sum(F.col("is_write").cast("bigint")).alias("writes"))
    return out.withColumn("reply", F.format_string("OK: tx=%s reads=%d writes=%d", F.col(txn).cast("string"), "reads", "writes"))


def executed(ops: DataFrame, state: DataFrame, updates: Mapping[str, Column], key: str = "item_key") -> tuple[DataFrame, DataFrame]:
    """(new state, missing operations) of a batch of key-value operations on a table keyed by `key`.

    Rows that some operation writes get the updates (expressions over state and the last operation's `value`); operations on keys that the
    table lacks come back, as their transactions must. One join; unwritten rows pass through it unchanged.
    """
    missing = ops.join(state.select(key), key, "left_anti")
    written = ops.where("is_write").groupBy(key).agg(F.max_by("value", "op_seq").alias("_value"))
    joined = state.join(written.withColumn("_hit", F.lit(True)), key, "left").withColumn("value_written", F.col("_value"))
    columns = [F.when(F.col("_hit"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in state.columns]
    return joined.select(*columns), missing
