"""Session factory and table loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "lakeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; everything else is left to the cluster unless given here."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a directory of Parquet tables; filters and columns reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
