"""Lock waits as a graph: cycles (deadlocks) and chains among (waiter, holder) edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.lineage import cut


def deadlock_cycles(edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(txn, cycle_length): every transaction that reaches itself, with its shortest way round (of at most `hops`, if given).

    Frontier expansion by joins. A transaction waits for few others at a time; paths are kept as (start, end) pairs,
    deduplicated in each step, so the work is pairs times edges of a node and not the number of paths. Each step is
    checkpointed, so plans stay small, and the walk ends with the last new pair.
    """
    edges = edges.select("waiter", "holder").where("waiter is not null and holder is not null").distinct()
    edges = cut(edges)
    frontier = edges.selectExpr("waiter txn", "holder at", "1 steps")
    seen = frontier
    for step in count(2) if hops is None else range(2, hops + 1):
        nxt = frontier.where("txn <> at").join(edges, F.col("at") == F.col("waiter")).select("txn", F.col("holder").alias("at"), F.lit(step).alias("steps")).distinct()
        frontier = cut(nxt.join(seen.select("txn", "at"), ["txn", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("txn = at").groupBy("txn").agg(F.min("steps").cast("int").alias("cycle_length"))


def deadlock_sql(table: str, hops: int = 16) -> str:
    """The same by a recursive query over a view of edges."""
    return f"""WITH RECURSIVE walk(txn, at, steps) AS (
        SELECT waiter, holder, 1 FROM {table}
        UNION ALL
        SELECT w.txn, e.holder, w.steps + 1 FROM walk w JOIN {table} e ON w.at = e.waiter WHERE w.steps < {hops} AND w.txn <> w.at)
    SELECT txn, CAST(MIN(steps) AS INT) AS cycle_length FROM walk WHERE txn = at GROUP BY txn"""


def resolved_locks(locks: DataFrame, statuses: DataFrame) -> DataFrame:
    """locks (row, txn) with `locked`: false where the writer's status is finished, whatever the row still says."""
    done = statuses.where(F.col("status").isin("committed", "aborted")).select("txn", F.lit(True).alias("_done"))
    return locks.join(done, "txn", "left").select(*locks.columns, F.col("_done").isNull().alias("locked"))
