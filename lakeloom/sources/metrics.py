"""Metric files (`key=value` lines) as long tables, and their roll-ups over nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A value that is a list of finite numbers.
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
# Counters that are summed over nodes; all others are averaged.
SUMMED = (
    "throughput", "fetch_from_remote_count", "fetch_from_storage_count", "fetch_from_local_count", "evicted_pages_count",
    "wait_log_flush_count", "ownership_transfer_count", "ownership_transfer_time_total", "notify_push_page_count", "notify_push_page_time",
    "wait_log_flush_time", "wait_log_flush_push_page_time", "wait_log_flush_evict_page_time", "wait_log_flush_tx_over_time",
    "log_flush_count", "log_flush_time", "log_flush_total_batch", "commit_log_count", "prepare_log_count", "backup_log_count", "update_log_count",
    "lazy_getpage_dire", "lazy_getpage_wait", "lazy_2RTT_count", "lazy_3RTT_count", "tx_begin_time", "tx_exe_time", "tx_fetch_exe_time",
    "tx_commit_time", "tx_abort_time", "TxWaitAbortLogTime", "wait_commit_log_time", "wait_prepare_log_time", "wait_backup_log_time",
    "tx_write_commit_log_time", "tx_write_commit_log_time2", "tx_write_prepare_log_time", "tx_write_backup_log_time", "tx_get_timestamp_time1",
    "tx_get_timestamp_time2", "twopc_remote_fetch_time", "twopc_remote_fetch_count", "fetch_storage_page_time", "single_txn_count",
    "distribute_txn_count", "hybrid_2pc_commit_count", "hybrid_lazy_commit_count",
)


def parse_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """lines with key, text (the value), and numbers (array<double>, null where the value isn't a list of numbers)."""
    pair = lines.where(F.instr(line, "=") > 0)
    key = F.trim(F.substring_index(line, "=", 1))
    text = F.trim(F.expr(f"substring(`{line}`, instr(`{line}`, '=') + 1)"))
    out = pair.withColumn("key", key).withColumn("text", text)
    numbers = F.when(F.col("text").rlike(rf"^{_NUMBER}(?:\s+{_NUMBER})*$"), F.transform(F.split("text", r"\s+"), lambda x: x.cast("double")))
    return out.withColumn("numbers", numbers).drop(line)


def read_nodes(spark: SparkSession, glob: str) -> DataFrame:
    """(node, key, text, numbers) of files such as .../node3/result.txt; the last line of a key counts, as in its file."""
    raw = spark.read.text(glob).select("value", F.regexp_extract(F.col("_metadata.file_path"), r"node(\d+)/", 1).cast("int").alias("node"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    parsed = parse_lines(raw)
    return parsed.groupBy("node", "key").agg(F.max_by("text", F.struct("at", "line")).alias("text"), F.max_by("numbers", F.struct("at", "line")).alias("numbers"))


def long_values(parsed: DataFrame, *ids: str) -> DataFrame:
    """(ids..., key, idx, number): one row for each number of a value."""
    return parsed.where("numbers is not null").select(*ids, "key", F.posexplode("numbers").alias("idx", "number"))


def totals(values: DataFrame, expected: int) -> DataFrame:
    """(key, total): the sum over nodes, null unless all expected nodes have the key."""
    return values.where("idx = 0").groupBy("key").agg(F.when(F.countDistinct("node") == expected, F.sum("number")).alias("total"))


def rolled_up(values: DataFrame, summed: Sequence[str] = SUMMED) -> DataFrame:
    """(key, idx, number) over nodes: lists are summed by element, single values summed or averaged by key."""
    sizes = values.groupBy("node", "key").agg(F.max("idx").alias("_last"))
    marked = values.join(sizes, ["node", "key"])
    is_sum = F.col("key").isin(list(summed)) | (F.col("_many") > 0)
    out = marked.groupBy("key", "idx").agg(F.sum("number").alias("_sum"), F.avg("number").alias("_avg"), F.max("_last").alias("_many"))
    return out.select("key", "idx", F.when(is_sum, F.col("_sum")).otherwise(F.col("_avg")).alias("number"))


def commit_rates(lines: DataFrame, line: str = "value") -> DataFrame:
    """(ts, node, tps) of log lines `[time] [Node n] [Commit TPS] ... number`."""
    pattern = r"^\[([0-9-]+ [0-9:.]+)\] \[Node (\d+)\] \[Commit TPS\]\D*([0-9.]+)?"
    hit = lines.where(F.col(line).rlike(pattern))
    return hit.select(F.try_to_timestamp(F.regexp_extract(line, pattern, 1)).alias("ts"), F.regexp_extract(line, pattern, 2).cast("int").alias("node"), F.expr(f"try_cast(regexp_extract(`{line}`, r'{pattern}', 3) as double)").alias("tps"))


def device_rates(samples: DataFrame, begin: object, end: object) -> DataFrame:
    """(device, seconds, operations, average, peak) of counters (device, time, monotonic_s, reads, writes) in [begin, end]."""
    from pyspark.sql import Window

    w = Window.partitionBy("device").orderBy("monotonic_s")
    inner = samples.where((F.col("time") >= F.lit(begin)) & (F.col("time") <= F.lit(end))).withColumn("ops", F.col("reads") + F.col("writes"))
    step = inner.withColumn("rate", (F.col("ops") - F.lag("ops").over(w)) / (F.col("monotonic_s") - F.lag("monotonic_s").over(w)))
    out = step.groupBy("device").agg((F.max("monotonic_s") - F.min("monotonic_s")).alias("seconds"), (F.max_by("ops", "monotonic_s") - F.min_by("ops", "monotonic_s")).alias("operations"), F.max("rate").alias("peak"))
    return out.where("seconds > 0").withColumn("average", F.col("operations") / F.col("seconds"))


def write_report(df: DataFrame, path: str, kind: str = "csv") -> None:
    """A result as csv (with header), parquet, json, or tab-separated text."""
    writer = df.write.mode("overwrite")
    if kind == "tsv":
        writer.option("header", True).option("sep", "\t").csv(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(kind).save(path)


# Numbers and names of the execution modes, and of the variants of two-phase commit.
MODES = {0: "eager", 1: "lazy", 2: "2pc", 3: "single", 4: "mix"}
VARIANTS = {0: "baseline", 1: "cornus", 2: "cornus_opt"}


def with_mode(df: DataFrame, code: str, variant: str | None = None) -> DataFrame:
    """df with `mode`, the name of its execution mode; two-phase modes (2pc, mix) carry their variant's name if it has a column."""
    names = F.create_map(*[F.lit(x) for pair in MODES.items() for x in pair])
    mode = names[F.col(code).cast("int")]
    if variant:
        kinds = F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair])
        mode = F.when(mode.isin("2pc", "mix"), F.concat_ws("/", mode, kinds[F.col(variant).cast("int")])).otherwise(mode)
    return df.withColumn("mode", mode)
