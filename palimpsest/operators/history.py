"""History of changing attributes from periodic, partial, dirty exports.

Merkle comparison: per export, ids are hashed into leaf buckets and leaves into a tree of fan-out
16; a node's digest is the XOR of two 64-bit hashes of its distinct rows, with their number. A
node is compared with the same node of the latest earlier export that has rows in it. Equal
nodes hold nothing new and are left out; only below differing nodes the comparison goes on, and
only the rows of differing leaves are diffed. What is new there is appended to the history.

The states are then laid along (id, time) by a range-partitioned sort, so that an id with any
number of states is spread over partitions, and folded to versions by a streamed scan.

Defined results: a row with a null in id, updated_at_ms, importance or status (also a blank
status or a NaN importance) tells nothing; of several states at one time the highest revision
holds (null lowest, then the greater importance, then status); equal successive states are one
version; ``valid_to_ms`` is -1 for the last; empty inputs give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import cut
from .ordered import PID, partition_summaries, range_sorted

FANOUT = 16
CURRENT = 2**63 - 1  #: export time standing for the table itself, after all exports
ROW = ["id", "at_ms", "revision", "importance", "status"]


def states(df: DataFrame, export: str | None) -> DataFrame:
    """Rows that tell a state: ``export_ms, id, at_ms, revision, importance, status``, cleaned."""
    told = df.select(
        (F.coalesce(F.col(export).cast("bigint"), F.lit(-1)) if export else F.lit(CURRENT)).alias("export_ms"),
        "id",
        F.col("updated_at_ms").cast("bigint").alias("at_ms"),
        F.col("revision").cast("bigint").alias("revision"),
        F.round(F.col("importance").cast("double"), 4).alias("importance"),
        F.lower(F.regexp_replace("status", r"^\s+|\s+$", "")).alias("status"),
    )
    return told.where("id IS NOT NULL AND at_ms IS NOT NULL AND importance IS NOT NULL AND NOT isnan(importance) AND status <> ''")


def _trees(rows: DataFrame, levels: int) -> list[DataFrame]:
    """Digests by level, root first: ``export_ms, node, digest``."""
    # every level above is made from the leaves' digests, which are written once
    leaf = cut(
        rows.groupBy("export_ms", "leaf").agg(
            F.bit_xor(F.xxhash64(*ROW)).alias("a"), F.bit_xor(F.xxhash64(F.lit(17), *ROW)).alias("b"), F.count("*").alias("n")
        )
    )
    out = []
    for level in range(levels + 1):
        node = F.expr(f"leaf div {FANOUT ** (levels - level)}").alias("node")
        out.append(
            leaf.groupBy("export_ms", node).agg(F.struct(F.bit_xor("a"), F.bit_xor("b"), F.sum("n")).alias("digest"))
        )
    return out


def changed_leaves(rows: DataFrame, levels: int) -> DataFrame:
    """``export_ms, leaf, before_ms``: leaves that differ from the latest earlier export with rows in them."""
    earlier = Window.partitionBy("node").orderBy("export_ms")
    open_nodes = None
    for tree in _trees(rows, levels):
        # a window group has at most one row per export
        seen = tree.select(
            "export_ms", "node", "digest", F.lag("digest").over(earlier).alias("before"), F.lag("export_ms").over(earlier).alias("before_ms")
        ).where("NOT (digest <=> before)")
        seen = seen.select("export_ms", "node", "before_ms")
        if open_nodes is not None:
            parents = open_nodes.select("export_ms", F.col("node").alias("parent"))
            seen = seen.withColumn("parent", F.expr(f"node div {FANOUT}")).join(parents, ["export_ms", "parent"], "left_semi")
        open_nodes = seen
    return open_nodes.select("export_ms", F.col("node").alias("leaf"), "before_ms")


def new_states(exports: DataFrame, levels: int) -> DataFrame:
    """States that a Merkle comparison of successive exports brings to light."""
    leaves = FANOUT**levels
    rows = cut(exports.distinct().withColumn("leaf", F.pmod(F.xxhash64("id"), F.lit(leaves))))
    changed = changed_leaves(rows, levels)
    candidates = rows.join(changed, ["export_ms", "leaf"])
    before = rows.select(F.col("export_ms").alias("before_ms"), *ROW)
    same = [candidates[c].eqNullSafe(before[c]) if c == "revision" else candidates[c] == before[c] for c in ["before_ms", *ROW]]
    fresh = candidates.join(before, same, "left_anti")
    return fresh.select(*ROW)


def versions(history: DataFrame) -> DataFrame:
    """Fold states (``id, at_ms, revision, importance, status``) to versions with their periods."""
    told = history.groupBy("id", "at_ms").agg(F.max(F.struct("revision", "importance", "status")).alias("s"))
    told = told.select("id", "at_ms", "s.revision", "s.importance", "s.status")
    told = told.withColumn("state", F.concat_ws("|", F.col("importance").cast("string"), "status"))
    placed = range_sorted(told, ["id", "at_ms"])

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last_id, last_state = None, None, None
        for b in batches:
            if not len(b):
                continue
            if out is None:
                f = b.iloc[0]
                out = {"pid": int(f[PID]), "first_id": f["id"], "first_state": f["state"], "first_ms": int(f["at_ms"]), "diff_ms": None, "single": True}
            if out["single"]:
                own = b["id"].eq(out["first_id"])
                other = b.loc[own & b["state"].ne(out["first_state"]), "at_ms"]
                if out["diff_ms"] is None and len(other):
                    out["diff_ms"] = int(other.iloc[0])
                out["single"] = bool(own.all())
            last_id, last_state = b["id"].iloc[-1], b["state"].iloc[-1]
        if out is not None:
            row = pd.DataFrame([{**out, "last_id": last_id, "last_state": last_state}])
            yield row.astype({"diff_ms": "Int64"})

    edge = partition_summaries(
        placed.select("id", "at_ms", "state", PID),
        edges,
        "pid int, first_id string, first_state string, first_ms bigint, diff_ms bigint, single boolean, last_id string, last_state string",
    )
    enters: dict[int, tuple] = {}
    leaves: dict[int, int] = {}
    for i, e in enumerate(edge):
        enters[e["pid"]] = (edge[i - 1]["last_id"], edge[i - 1]["last_state"]) if i else (None, None)
    for i, e in enumerate(edge):
        then, at = e["last_state"], -1
        for n in edge[i + 1 :]:
            if n["first_id"] != e["last_id"]:
                break
            found = n["first_ms"] if n["first_state"] != then else n["diff_ms"]
            if found is not None:
                at = found
                break
            if not n["single"]:
                break
        leaves[e["pid"]] = at

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, after, key, state = None, -1, None, None
        for b in batches:
            if not len(b):
                continue
            if held is None and key is None:
                (key, state), after = enters[int(b[PID].iloc[0])], leaves[int(b[PID].iloc[0])]
            before_id, before_state = b["id"].shift(), b["state"].shift()
            before_id.iloc[0], before_state.iloc[0] = key, state
            key, state = b["id"].iloc[-1], b["state"].iloc[-1]
            starts = b[b["id"].ne(before_id) | b["state"].ne(before_state)]
            v = starts if held is None or not len(held) else pd.concat([held, starts])
            if len(v) > 1:
                follows = v["id"].shift(-1).eq(v["id"])
                done = v.assign(valid_to_ms=v["at_ms"].shift(-1).where(follows, -1))[:-1]
                yield _named(done)
            held = v[-1:]
        if held is not None and len(held):
            yield _named(held.assign(valid_to_ms=after if held["id"].iloc[0] == key else -1))

    def _named(v: pd.DataFrame) -> pd.DataFrame:
        v = v.rename(columns={"at_ms": "valid_from_ms"}).astype({"valid_to_ms": "int64"})
        return v[["id", "valid_from_ms", "valid_to_ms", "revision", "importance", "status"]]

    return placed.mapInPandas(
        scan, "id string, valid_from_ms bigint, valid_to_ms bigint, revision bigint, importance double, status string"
    )


def history(snapshots: DataFrame, current: DataFrame, leaf_rows: int = 64) -> DataFrame:
    """All versions of every id: ``id, valid_from_ms, valid_to_ms, revision, importance, status``.

    ``leaf_rows`` is the mean number of rows of one export that a leaf bucket should hold; it sets
    the depth of the tree from the row counts and never which rows are compared.
    """
    largest = max(current.count(), snapshots.count(), 1)
    levels = max(1, math.ceil(math.log(max(largest / leaf_rows, 2), FANOUT)))
    exports = states(snapshots, "snapshot_at_ms").unionByName(states(current, None))
    return versions(new_states(exports, levels))
