"""Prepare votes of distributed transactions: decided once all participants have said yes, or one no, or time is up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def decisions(votes: DataFrame, ts: str = "ts", lateness: str = "10 seconds", timeout_ms: int = 5_000) -> DataFrame:
    """(txn, decision, voters) of a stream of (txn, node, participants, vote, ts): one row for each transaction.

    decision: commit (every participant voted yes), abort (a no), or timeout (the watermark passed its first vote by
    timeout_ms, whatever came later). Repeated votes of a node count once; votes may come in any order.
    """
    rows = votes.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", lateness).select("txn", "node", "participants", "vote", "ts")
    kind = votes.schema["txn"].dataType.simpleString()

    def decide(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nodes, refused, done, need, first = (list(state.get[0]), *state.get[1:]) if state.exists else ([], False, False, 0, None)
        told = None
        if state.hasTimedOut:
            if not done:
                told = "timeout"
            state.remove()
        else:
            for part in parts:
                nodes = sorted(set(nodes) | set(part["node"].tolist()))
                refused = refused or not bool(part["vote"].all())
                need = max(need, int(part["participants"].max()))
                at = int(part["ts"].min().timestamp() * 1000)
                first = at if first is None else min(first, at)
            if not done and (refused or len(nodes) >= need):
                told, done = ("abort" if refused else "commit"), True
            state.update(([int(n) for n in nodes], bool(refused), bool(done), int(need), int(first)))
            state.setTimeoutTimestamp(max(first + timeout_ms, state.getCurrentWatermarkMs() + 1))
        if told:
            yield pd.DataFrame([[key[0], told, len(nodes)]], columns=["txn", "decision", "voters"])

    return rows.groupBy("txn").applyInPandasWithState(decide, f"txn {kind}, decision string, voters int", "nodes array<int>, refused boolean, done boolean, need int, first bigint", "append", GroupStateTimeout.EventTimeTimeout)


def decided(votes: DataFrame) -> DataFrame:
    """(txn, decision, voters) of a finished table of votes: undecided transactions have timed out."""
    out = votes.groupBy("txn").agg(F.countDistinct("node").cast("int").alias("voters"), F.max("participants").alias("_n"), F.bool_and("vote").alias("_all"))
    decision = F.when(~F.col("_all"), "abort").when(F.col("voters") >= F.col("_n"), "commit").otherwise("timeout")
    return out.select("txn", decision.alias("decision"), "voters")
