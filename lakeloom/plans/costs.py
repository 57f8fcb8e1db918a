"""The cost model that chooses between moving pages (lazy) and committing at their owners (two-phase), set-oriented.

accesses: (txn, table, page, write, home); estimates: (table, page, kind, ms); states: (txn, table, page, usable, upgrade).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostConfig:
    # Defaults of the model.
    rpc_rtt_ms: float = 0.5
    log_wait_ms: float = 0.5
    initial_page_ms: float = 1.0
    include_2pc_execution_cost: bool = True
    historical_threshold: float = 0.2

    def __post_init__(self) -> None:
        if min(self.rpc_rtt_ms, self.log_wait_ms, self.initial_page_ms) < 0 or not 0 <= self.historical_threshold <= 1:
            raise ValueError("times are not negative, the threshold is a share")

    @property
    def commit_delta_ms(self) -> float:
        return 2 * self.rpc_rtt_ms + 2 * self.log_wait_ms


def hot_key_decision(hot: Column, total: Column, threshold: float, any_hot: bool = False) -> Column:
    """Whether the share of hot keys speaks for two-phase commit; any_hot: whether one is enough."""
    return hot > 0 if any_hot else (total <= 0) | (hot / total >= threshold)


def online_delta(phases: DataFrame, own: DataFrame) -> DataFrame:
    """(txn, commit_delta_ms) from measured means: slowest participant's prepare and commit, less the own commit, plus backup.

    phases: (txn, node, rpc_ms, prepare_ms, commit_ms), one row a participant; own: (txn, backup_ms, commit_ms).
    """
    slowest = phases.groupBy("txn").agg(F.max(F.col("rpc_ms") + F.col("prepare_ms")).alias("p"), F.max(F.col("rpc_ms") + F.col("commit_ms")).alias("c"))
    return slowest.join(own, "txn").select("txn", F.greatest(F.lit(0.0), F.col("p") + F.col("backup_ms") + F.col("c") - F.col("commit_ms")).alias("commit_delta_ms"))


def decide(accesses: DataFrame, estimates: DataFrame, local: int, config: CostConfig | None = None, states: DataFrame | None = None, deltas: DataFrame | None = None) -> DataFrame:
    """(txn, eligible, lazy_ms, twopc_ms, commit_delta_ms, twopc) of each transaction.

    Accesses are dealt out by transaction once, and counted by page and then by transaction there; estimates by kind are
    a few rows and are broadcast, whether those by page are is left to their size.
    A transaction with one writing node or none isn't eligible. Pages are costed once, with the write flag of any access;
    remote operations are costed one by one. Estimates are taken by page and kind, else by kind (table and page null), else the initial value.
    """
    config = config or CostConfig()

    def by_kind(kinds: tuple[str, ...], name: str) -> DataFrame:
        return F.broadcast(estimates.where(F.col("kind").isin(*kinds) & F.col("page").isNull()).groupBy("kind").agg(F.first("ms").alias(name)))

    calls = accesses.repartition("txn").withColumn("kind", F.when(F.col("write"), "remote_write").otherwise("remote_read")).join(by_kind(("remote_read", "remote_write"), "remote_ms"), "kind", "left")
    rpc = F.when(F.col("home") != local, F.coalesce("remote_ms", F.lit(config.rpc_rtt_ms))).otherwise(0.0)
    writer = F.collect_set(F.when(F.col("write"), F.col("home")))
    pages = calls.groupBy("txn", "table", "page").agg(F.sum(rpc).alias("calls_ms"), writer.alias("writers"), F.bool_or("write").alias("write"), F.min("home").alias("home"))
    if states is not None:
        pages = pages.join(states, ["txn", "table", "page"], "left")
    else:
        pages = pages.withColumn("usable", F.lit(False)).withColumn("upgrade", F.lit(False))
    kind = F.when(F.coalesce("upgrade", F.lit(False)), "upgrade").when(F.col("write"), "write").otherwise("read")
    by_page = estimates.where("page is not null").select("table", "page", "kind", F.col("ms").alias("page_ms"))
    costed = pages.withColumn("kind", kind).join(by_page, ["table", "page", "kind"], "left").join(by_kind(("read", "write", "upgrade"), "kind_ms"), "kind", "left")
    ms = F.when(F.coalesce("usable", F.lit(False)), 0.0).otherwise(F.coalesce("page_ms", "kind_ms", F.lit(config.initial_page_ms)))
    out = costed.groupBy("txn").agg(
        F.sum(ms).alias("lazy_ms"), F.sum(F.when(F.col("home") == local, ms).otherwise(0.0)).alias("shared_ms"), F.sum("calls_ms").alias("calls_ms"),
        F.size(F.array_distinct(F.flatten(F.collect_list("writers")))).alias("writers"),
    )
    if deltas is not None:
        out = out.join(deltas, "txn", "left")
    else:
        out = out.withColumn("commit_delta_ms", F.lit(config.commit_delta_ms))
    eligible = (F.col("writers") > 1) & F.col("commit_delta_ms").isNotNull()
    twopc = F.col("calls_ms") + F.col("shared_ms") if config.include_2pc_execution_cost else F.lit(0.0)
    keep = lambda c: F.when(eligible, c).otherwise(0.0)
    out = out.select("txn", eligible.alias("eligible"), keep(F.col("lazy_ms")).alias("lazy_ms"), keep(twopc).alias("twopc_ms"), keep(F.col("commit_delta_ms")).alias("commit_delta_ms"))
    return out.withColumn("twopc", F.col("eligible") & (F.col("lazy_ms") > F.col("twopc_ms") + F.col("commit_delta_ms")))
