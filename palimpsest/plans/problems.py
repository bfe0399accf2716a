"""Catalogue of the general (non-llm) problem queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import changefeed, history
from ..sources.tables import load


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return changefeed.last_effective_operation(load(spark, root, "operations"))


def p2_state(spark: SparkSession, root: str) -> DataFrame:
    return changefeed.current_state(load(spark, root, "operations"))


def p6_history(spark: SparkSession, root: str) -> DataFrame:
    return history.history(load(spark, root, "memory_snapshots"), load(spark, root, "memories"))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_history(spark, root).select("id", "valid_from_ms", "valid_to_ms")


QUERIES = {"p2_found": p2_found, "p2_state": p2_state, "p6_found": p6_found, "p6_history": p6_history}
