"""A corpus pipeline over `documents`: each stage works on all that its predecessor kept.

STAGES: (name, f(spark, docs, sf_dir) -> DataFrame). run() writes each stage's rows as a table in the shared folder and
reads it again as the next one's documents. All stages but the last return the columns of documents; the last returns,
for each document that is left, its doc_id and the digests of its tokens. Rows with a null doc_id pass the filtering
stages (they can't be matched to a decision, and clean documents are kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm import bpe, decontam, near, pii, quality
from lakeloom.llm._durable import smaller_partitions, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts travel to Python and back in batches of at most so many rows: it is batches of long texts that take memory, on both sides.
BATCH_ROWS = 2_000


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches for the rest of the pipeline, which outlives the stage's function: plans run later."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    _small_batches(spark)
    return quality.keep(docs, _table(spark, sf_dir, "labels"))


#: Rows to drop (16 bytes each) up to which they are broadcast; beyond that, documents are joined to them.
BROADCAST_ROWS = 1_000_000


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row of each group of near copies: the one of the smallest doc_id (of rows that repeat it, that of the least hash).

    Groups are those of 5-word shingles with a similarity of 0.8 or more, and what they reach, found by SimHash and completed by
    MinHash (near.py); rows are told apart by doc_id and a hash of all columns. Rows with a null doc_id belong to no group and stay.
    """
    _small_batches(spark)
    maps = {f.name for f in docs.schema.fields if "map<" in f.dataType.simpleString()}  # which have no hash
    rows = docs.withColumn("mark of the row", F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in docs.columns]))
    known = rows.where("doc_id is not null").select("doc_id", "text", F.col("mark of the row").alias("mark"))
    with smaller_partitions(spark, "16m"):
        first = near.firsts(known, key="doc_id", mark="mark", text="text").withColumnRenamed("key", "doc_id")
        counts = known.groupBy("doc_id", "mark").count()
        # what needs a decision is the rows that go, and of rows that are equal in all columns all but one
        odd = written(counts.join(first.withColumn("stays", F.lit(True)), ["doc_id", "mark"], "left").where("stays is null or count > 1"))
    some = F.broadcast(odd) if odd.count() <= broadcast_rows else odd
    some = some.select(F.col("doc_id").alias("odd id"), F.col("mark").alias("mark of the row"), "stays")
    on = (F.col("doc_id") == F.col("odd id")) & (rows["mark of the row"] == some["mark of the row"])
    kept = rows.join(some, on, "left_anti").drop("mark of the row")
    again = rows.join(some.where("stays"), on, "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id", "mark of the row").orderBy("mark of the row"))
    return kept.union(again.withColumn("place in order", place).where("`place in order` = 1").select(kept.columns))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    _small_batches(spark)
    return decontam.clean(docs, _table(spark, sf_dir, "benchmark"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the byte-level BPE ids, and of the bytes decoded from them."""
    import public_tokenizers

    _small_batches(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, memo_words=60_000, forget=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("PII", redact_pii),
    ("byte-level BPE", encode),
]

#: No stage can be expressed in SQL as a whole (learnt weights, SimHash of XXH64, BPE); see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
