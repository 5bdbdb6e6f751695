"""Readers for the input tables (one parquet dataset per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations"]


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Lazy scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
