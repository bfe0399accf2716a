"""Cutting lineage in storage that outlives an executor."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the one the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of this machine, which goes with the process;
    a cluster without a shared folder is an error, never a silent local fallback.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="palimpsest-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once, reliably, so that later passes read identical partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sweep(spark: SparkSession) -> None:
    """Have the files of shuffles and checkpoints that nothing refers to any more deleted; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what Python lets go, the JVM is told in the background, and deletes after its next collection
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, over all cores if it comes in fewer partitions; large tables are left as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
