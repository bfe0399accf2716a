"""Streaming ingestion of operations (an extension: the store itself has no streams).

Operations arrive as files or any other streaming source, late and repeated. Copies are dropped
within the watermark, each micro-batch is appended as one committed batch; writing a batch again
after a failure replaces it, so every operation is in the log once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import trimmed_lower

SCHEMA = "operation_id string, memory_id string, kind string, payload_json string, state string, created_at_ms bigint, applied_at_ms bigint"


def operations_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Operations from Parquet files as they appear, each operation once within ``delay``."""
    rows = spark.readStream.schema(SCHEMA).parquet(path)
    rows = rows.where("operation_id IS NOT NULL AND created_at_ms IS NOT NULL").withColumn("kind", trimmed_lower(F.col("kind")))
    timed = rows.withColumn("ts", F.timestamp_millis("created_at_ms")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["operation_id"])


def counts_by_window(operations: DataFrame, window: str = "7 days") -> DataFrame:
    """Operations by kind and window of their time, for a stream or a table with ``ts``."""
    return operations.groupBy(F.window("ts", window), "kind").agg(F.count("*").alias("operations"))


def append_to_log(operations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch below ``path`` as ``batch=<n>``."""

    def write(batch: DataFrame, n: int) -> None:
        batch.drop("ts").write.mode("overwrite").parquet(f"{path}/batch={n}")

    return operations.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
