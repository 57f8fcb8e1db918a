"""Durable intermediate results of the operators, and plans in smaller partitions."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from lakeloom.lineage import cut, shared_dir, written

_ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@contextmanager
def smaller_partitions(spark: SparkSession, size: str) -> Iterator[None]:
    """Adaptive execution joins partitions up to `size` at most, for what runs meanwhile: rows of whole texts take several times
    their compressed size when they are sorted. A session that advises less keeps its own."""
    in_bytes, before = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes, spark.conf.get(_ADVISED)
    if in_bytes(before) <= in_bytes(size):
        yield
        return
    spark.conf.set(_ADVISED, size)
    try:
        yield
    finally:
        spark.conf.set(_ADVISED, before)


__all__ = ["cut", "shared_dir", "smaller_partitions", "written"]
