"""Sinks: vectors by document, query logs, result reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_vectors(rows: DataFrame, path: str, by: str, mode: str = "append") -> None:
    """Chunks with their vectors, one folder per value of `by`: documents are found and replaced without reading the others. With mode `overwrite` only the folders in rows are replaced."""
    rows.repartition(F.col(by)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def vectors(spark: SparkSession, path: str, by: str, *values: object) -> DataFrame:
    """The stored vectors, or those of the given values of `by` alone."""
    held = spark.read.parquet(path)
    return held.where(F.col(by).isin(*values)) if values else held


def log_queries(rows: DataFrame, path: str) -> None:
    """Appends (user_id, query, retrieved, created_at) to the log; what was retrieved is kept as JSON."""
    rows.select("user_id", "query", F.to_json("retrieved").alias("retrieved"), "created_at").write.mode("append").parquet(path)


def recent_queries(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The n latest rows of the log, the latest first."""
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "user_id", "query").limit(n)


def write_report(rows: DataFrame, path: str) -> None:
    """Results as JSON lines that keep null fields."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
