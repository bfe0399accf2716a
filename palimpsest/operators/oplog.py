"""The operation log: idempotence, pending work, optimistic updates, recovery.

Defined results: rows without operation_id can't be told apart and don't count here; of several
deliveries of an operation the earliest time and the greatest non-null other fields hold; an
operation is applied as soon as one delivery says so; kinds and states are read without regard to
case and outer blanks; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trimmed_lower
from .ordered import PID, partition_summaries, range_sorted

_NONE = -(2**63) + 1


def revision_of(payload: Column) -> Column:
    """The revision in a payload, also in one that was cut off behind it; else null."""
    return F.regexp_extract(payload, r'"revision"\s*:\s*"?(\d+)"?\s*[,}]', 1).try_cast("bigint")


def operations_once(log: DataFrame) -> DataFrame:
    """``operation_id, memory_id, kind, state, created_at_ms, revision, deliveries``, one row per operation."""
    rows = log.where("operation_id IS NOT NULL").select(
        "operation_id",
        "memory_id",
        trimmed_lower(F.col("kind")).alias("kind"),
        (trimmed_lower(F.col("state")) == "applied").alias("done"),
        "created_at_ms",
        revision_of(F.col("payload_json")).alias("revision"),
    )
    return rows.groupBy("operation_id").agg(
        F.max("memory_id").alias("memory_id"),
        F.max("kind").alias("kind"),
        F.when(F.coalesce(F.max("done"), F.lit(False)), "applied").otherwise("pending").alias("state"),
        F.min("created_at_ms").alias("created_at_ms"),
        F.max("revision").alias("revision"),
        F.count("*").alias("deliveries"),
    )


def pending(log: DataFrame) -> DataFrame:
    """Operations that no delivery calls applied."""
    return operations_once(log).where("state = 'pending'").select("operation_id", "memory_id", "kind", "created_at_ms")


_STEPS = "memory_id string, operation_id string, revision bigint, current_revision bigint, outcome string"


class _Replay:
    """The record of one memory at a time: whether it exists, and its revision."""

    def __init__(self, key: str | None = None, alive: bool = False, revision: int | None = None):
        self.key, self.alive, self.revision, self.told, self.runs = key, alive, revision, False, 0

    def step(self, key: str, kind: str, revision: int | None) -> tuple[int | None, str | None]:
        """Apply an operation; the revision before it and, of an update, its outcome."""
        if key != self.key:
            self.key, self.alive, self.revision, self.told, self.runs = key, False, None, True, self.runs + 1
        before = self.revision if self.alive else None
        if kind != "update":
            self.alive, self.revision, self.told = kind == "remember", revision, True
            return before, None
        if not self.alive:
            return None, "not_found"
        if revision is None or before is None or revision != before + 1:
            return before, "revision_conflict"
        self.revision = revision
        return before, "applied"


def _last(rows: Iterable, state: _Replay) -> _Replay:
    for r in rows:
        state.step(r["memory_id"], r["kind"], r["revision"])
    return state


def update_outcomes(log: DataFrame) -> DataFrame:
    """``memory_id, operation_id, revision, current_revision, outcome`` of every update in the log's order.

    The log is replayed: an update is ``not_found`` if its memory doesn't exist at that point, a
    ``revision_conflict`` if it doesn't raise the memory's revision by one, else ``applied``; only an
    applied one changes the revision. ``current_revision`` is that of the memory before the update,
    null if it doesn't exist. A memory that spans partitions is replayed across them.
    """
    ops = operations_once(log).where("memory_id IS NOT NULL AND btrim(memory_id) <> '' AND kind IN ('remember', 'update', 'delete')")
    ops = ops.select("memory_id", "operation_id", "kind", F.coalesce("created_at_ms", F.lit(_NONE)).alias("at"), F.coalesce("revision", F.lit(_NONE)).alias("rev"), "revision")
    placed = range_sorted(ops, ["memory_id", "at", "rev", "operation_id"])

    def rows(b: pd.DataFrame) -> Iterator[tuple[str, str, int | None]]:
        return zip(b["memory_id"], b["kind"], (None if pd.isna(r) else int(r) for r in b["revision"]))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # without what came before; ``told`` says whether the last memory's state needs it
        state, first, pid = _Replay(), None, None
        for b in batches:
            for key, kind, revision in rows(b):
                if first is None:
                    first, pid = key, int(b[PID].iloc[0])
                state.step(key, kind, revision)
                if state.runs == 1 and kind == "update" and not state.alive:
                    state.told = False
        if first is not None:
            out = pd.DataFrame([[pid, first, state.key, state.runs == 1 and not state.told, state.alive, state.revision]], columns=["pid", "first", "last", "open", "alive", "revision"])
            yield out.astype({"revision": "Int64"})

    schema = "pid int, first string, last string, open boolean, alive boolean, revision bigint"
    enters: dict[int, tuple] = {}
    held: tuple = (None, False, None)
    for e in partition_summaries(placed.select("memory_id", "kind", "revision", PID), edges, schema):
        enters[e["pid"]] = held if held[0] == e["first"] else (None, False, None)
        if e["open"] and enters[e["pid"]][1]:
            # a whole partition of nothing but updates of an existing memory: only a replay tells its end
            came = enters[e["pid"]]
            end = log.sparkSession.sparkContext.runJob(placed.select("memory_id", "kind", "revision").rdd, lambda it, came=came: [vars(_last(it, _Replay(*came)))], [e["pid"]])[0]
            held = (end["key"], end["alive"], end["revision"])
        else:
            held = (e["last"], e["alive"], e["revision"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for b in batches:
            if not len(b):
                continue
            state = state or _Replay(*enters[int(b[PID].iloc[0])])
            steps = [state.step(*r) for r in rows(b)]
            out = b[["memory_id", "operation_id", "revision"]].assign(current_revision=pd.array([s[0] for s in steps], "Int64"), outcome=[s[1] for s in steps])
            yield out[out["outcome"].notna()].astype({"revision": "Int64"})

    return placed.mapInPandas(scan, _STEPS)


def recovered(log: DataFrame, records: DataFrame) -> DataFrame:
    """``memory_id, operation_id, kind, action``: what a restart does with each pending operation.

    A pending deletion is a ``remove``; a remember or update whose record (``id, status``) is there is
    an ``upsert`` if the record is pending or active and merely ``applied`` otherwise; without a record it is ``left``.
    """
    ops = pending(log).where("memory_id IS NOT NULL AND btrim(memory_id) <> '' AND kind IN ('remember', 'update', 'delete')")
    known = records.select(F.col("id").alias("memory_id"), "status")
    action = (
        F.when(F.col("kind") == "delete", "remove").when(F.col("status").isNull(), "left").when(F.col("status").isin("pending", "active"), "upsert").otherwise("applied")
    )
    return ops.join(known, "memory_id", "left").select("memory_id", "operation_id", "kind", action.alias("action"))


def tombstones(log: DataFrame) -> DataFrame:
    """``memory_id, operation_id``: memories whose last creation or removal is a removal."""
    ops = operations_once(log).where("memory_id IS NOT NULL AND btrim(memory_id) <> '' AND kind IN ('remember', 'delete')")
    order = F.struct(F.coalesce("created_at_ms", F.lit(_NONE)).alias("at"), F.coalesce("revision", F.lit(_NONE)).alias("rev"), "operation_id", "kind")
    last = ops.groupBy("memory_id").agg(F.max(order).alias("o"))
    return last.where("o.kind = 'delete'").select("memory_id", "o.operation_id")
