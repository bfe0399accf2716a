"""Order-dependent operators without one-task groups.

A window over a hot key sorts that key's rows in one task. Here rows are range-partitioned by
(key, order, tie-break) instead, so a hot key spreads over many partitions, each partition is
sorted externally and scanned as a stream, and only a summary row per partition travels to the
driver, where neighbouring partitions are stitched. The summary is bounded by the number of
partitions, never by the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import cut

PID = "__partition"


def range_sorted(df: DataFrame, by: list[Column | str], partitions: int | None = None, expensive: bool = False) -> DataFrame:
    """``df`` range-partitioned and sorted by ``by``, with its partition number in ``__partition``.

    Range bounds come from sampling, so the result is checkpointed: every later pass sees the
    same rows in the same partitions, also after an executor is lost. The sampling runs ``df`` once
    more, so an ``expensive`` one is written before; then there are at least as many partitions as it has.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if expensive:
        df = cut(df)
        n = partitions or max(n, df.rdd.getNumPartitions())
    ranged = df.repartitionByRange(n, *by).sortWithinPartitions(*by)
    return cut(ranged.withColumn(PID, F.spark_partition_id()))


def partition_summaries(
    df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> list[dict]:
    """One summary row per non-empty partition, by partition number."""
    rows = df.mapInPandas(fn, schema).collect()
    return sorted((r.asDict() for r in rows), key=lambda r: r["pid"])


def key_hash(keys: list[str]) -> Column:
    """128 bits standing for the key in the summaries, so that long keys stay out of the driver."""
    typed = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(typed, 256), 1, 32)


def running_totals(
    df: DataFrame, keys: list[str], order: list[Column], weight: str | None, out: str
) -> DataFrame:
    """Add ``out``: the running sum of ``weight`` (1 if None) within ``keys`` in ``order``, own row included.

    ``order`` must end in a tie-break that makes it total. Null keys form a key of their own; a
    null weight counts as 0; an empty input gives an empty result. Exact for any group size.
    """
    prepared = df.withColumn("__k", key_hash(keys)).withColumn(
        "__w", F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    )
    placed = range_sorted(prepared, [*[F.col(k) for k in keys], *order])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, first, last, last_total, runs = None, None, None, 0.0, 0
        for b in batches:
            if not len(b):
                continue
            pid = int(b["pid"].iloc[0])
            starts = b["k"].ne(b["k"].shift()).cumsum()
            for key, total in zip(b["k"].groupby(starts).first(), b["w"].groupby(starts).sum()):
                if key != last:
                    first = key if runs == 0 else first
                    last, last_total, runs = key, 0.0, runs + 1
                last_total += float(total)
        if pid is not None:
            yield pd.DataFrame([[pid, first, last, last_total, runs]], columns=["pid", "first", "last", "last_total", "runs"])

    summaries = partition_summaries(
        placed.select(F.col(PID).alias("pid"), F.col("__k").alias("k"), F.col("__w").alias("w")),
        edges,
        "pid int, first string, last string, last_total double, runs int",
    )
    carry: dict[int, float] = {}
    open_key, open_total = None, 0.0
    for s in summaries:
        carry[s["pid"]] = open_total if s["first"] == open_key else 0.0
        open_total = s["last_total"] + (carry[s["pid"]] if s["runs"] == 1 else 0.0)
        open_key = s["last"]

    fields = [f for f in placed.schema.fields if f.name not in (PID, "__k", "__w")]
    names = [f.name for f in fields]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, base = None, None
        for b in batches:
            if not len(b):
                continue
            if base is None:
                key, base = b["__k"].iloc[0], carry[int(b[PID].iloc[0])]
            k = b["__k"]
            starts = k.ne(k.shift()).cumsum()
            total = b["__w"].groupby(starts).cumsum()
            same = starts.eq(1) & (k.iloc[0] == key)
            total = total + same.astype(float) * base
            key, base = k.iloc[-1], float(total.iloc[-1])
            yield b[names].assign(**{out: total})

    schema = placed.select(*names).schema.add(out, "double")
    return placed.mapInPandas(scan, schema)


def previous_row(df: DataFrame, keys: list[str], order: list[Column], columns: dict[str, str]) -> DataFrame:
    """Add, under new names, ``columns`` of the row before in ``order`` within ``keys``; null for the first.

    ``order`` must be total. Exact for any group size; null keys form a key of their own.
    """
    prepared = df.withColumn("__k", key_hash(keys))
    placed = range_sorted(prepared, [*[F.col(k) for k in keys], *order])
    kept = [F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("v")]

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for b in batches:
            last = b[-1:] if len(b) else last
        if last is not None:
            yield last[["pid", "k", "v"]]

    summaries = partition_summaries(placed.select(F.col(PID).alias("pid"), F.col("__k").alias("k"), *kept), edges, "pid int, k string, v string")
    carry = {s["pid"]: summaries[i - 1] if i else {"k": None, "v": None} for i, s in enumerate(summaries)}
    fields = [f for f in placed.schema.fields if f.name not in (PID, "__k", "__v")]
    names = [f.name for f in fields]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = value = None
        fresh = True
        for b in batches:
            if not len(b):
                continue
            if fresh:
                came = carry[int(b[PID].iloc[0])]
                key, value, fresh = came["k"], came["v"], False
            before_k, before_v = b["__k"].shift(), b["__v"].shift()
            before_k.iloc[0], before_v.iloc[0] = key, value
            key, value = b["__k"].iloc[-1], b["__v"].iloc[-1]
            yield b[names].assign(__before=before_v.where(before_k.eq(b["__k"]), None))

    schema = placed.select(*names).schema.add("__before", "string")
    out = placed.withColumn("__v", kept[0]).mapInPandas(scan, schema)
    types = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in columns)
    out = out.withColumn("__before", F.from_json("__before", types))
    return out.select(*names, *[F.col(f"__before.{c}").alias(n) for c, n in columns.items()])
