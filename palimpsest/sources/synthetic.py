"""Synthetic vectors for benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_vectors(spark: SparkSession, n: int, dims: int, seed: int = 1) -> DataFrame:
    """``id, vec``: n vectors uniform in the unit cube, made where they are needed; hashes stand in for a generator, so rows are reproducible."""
    cell = lambda i: (F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(1 << 24)) / F.lit(float(1 << 24))).cast("float")
    return spark.range(n).withColumn("vec", F.transform(F.sequence(F.lit(1), F.lit(dims)), cell))
