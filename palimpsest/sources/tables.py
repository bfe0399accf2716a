"""Table sources: every table is one Parquet path ``<root>/<name>.parquet``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read table ``name`` below ``root``; file listing, pruning and pushdown are Spark's own."""
    return spark.read.parquet(f"{root}/{name}.parquet")
