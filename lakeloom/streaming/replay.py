"""Redo of a change log into a table: batches are merged by key, the greatest log number wins, repeats change nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.windows import latest


class ReplayedTable:
    """Images by key in buckets of keys; a batch rewrites the buckets that it touches, as directories of its number.

    A bucket's newest complete directory counts. A deleted key keeps its row (op `delete`) so that late records of
    older log numbers stay without effect; rows() leaves them out. A batch that is run again writes the same directories anew
    from what was there before it; what two later batches have replaced is removed.
    """

    def __init__(self, spark, path: str, key: Sequence[str], lsn: str = "lsn", op: str = "op", buckets: int = 64):
        self.spark, self.path, self.key, self.lsn, self.op, self.buckets = spark, path.rstrip("/"), list(key), lsn, op, buckets
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _held(self) -> dict[int, list[int]]:
        """Of each bucket the complete batches that have written it, oldest first."""
        held: dict[int, list[int]] = {}
        if self._fs.exists(self._path(self.path)):
            for batch in self._fs.listStatus(self._path(self.path)):
                at = batch.getPath()
                if at.getName().startswith("v") and self._fs.exists(self._path(at, "_SUCCESS")):
                    for part in self._fs.listStatus(at):
                        if part.getPath().getName().startswith("_b-"):
                            held.setdefault(int(part.getPath().getName()[3:]), []).append(int(at.getName()[1:]))
        return {b: sorted(v) for b, v in held.items()}

    def _at(self, batch: int, bucket: int) -> str:
        return f"{self.path}/v{batch}/_b-{bucket}"

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        batch = batch.persist()
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        held = self._held()
        before = [self._at(max(v for v in held[b] if v < batch_id), b) for b in touched if any(v < batch_id for v in held.get(b, ()))]
        rows = batch.unionByName(self.spark.read.schema(batch.schema).parquet(*before)) if before else batch
        image = latest(rows, self.key, self.lsn).withColumn("_bucket", bucket).repartition("_bucket")
        pending = f"{self.path}/.pending-{batch_id}"
        image.write.mode("overwrite").partitionBy("_bucket").parquet(pending)
        target = self._path(f"{self.path}/v{batch_id}")
        self._fs.delete(target, True)
        self._fs.mkdirs(target)
        for b in touched:
            self._fs.rename(self._path(f"{pending}/_bucket={b}"), self._path(self._at(batch_id, b)))
        self._fs.create(self._path(target, "_SUCCESS"), True).close()
        self._fs.delete(self._path(pending), True)
        batch.unpersist()
        for b in touched:
            for old in [v for v in held.get(b, ()) if v < batch_id][:-2]:
                self._fs.delete(self._path(self._at(old, b)), True)

    def rows(self, schema=None) -> DataFrame:
        held = self._held()
        if not held:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema) if schema else self.spark.read
        return read.parquet(*[self._at(v[-1], b) for b, v in sorted(held.items())]).where(f"`{self.op}` <> 'delete'")

    def run(self, log: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Starts the replay of a streaming log."""
        return log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
