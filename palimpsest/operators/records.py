"""The canonical records: latest state, lookups, lifecycle and health.

A record's rows are states; the latest is that of the highest revision, then of the latest update
(then of the greater remaining fields, so that the choice never depends on row order). The choice
is an aggregation that combines on the map side, so an id that fills a third of the table is fine.

Defined results: rows without id don't count; a null status is ``pending``, an unknown kind
``episodic``; status and kind are read without regard to case and outer blanks; a null expiry
never expires; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import trimmed_lower

# fixed values
KINDS = ("episodic", "fact", "preference", "instruction", "context")
STATUSES = ("pending", "active", "deleted", "expired")
_ORDER = ["revision", "updated_at_ms", "access_count", "last_accessed_at_ms", "importance", "expires_at_ms", "status", "metadata_json"]


def kind_of(c: Column) -> Column:
    k = trimmed_lower(c)
    return F.when(k.isin(*KINDS), k).otherwise("episodic")


def status_of(c: Column) -> Column:
    s = trimmed_lower(c)
    return F.when(s.isin(*STATUSES), s).otherwise("pending")


def latest(memories: DataFrame, columns: list[str]) -> DataFrame:
    """``id`` and ``columns`` of each record's latest state, with kind and status normalised."""
    order = []
    for c in _ORDER:
        low = F.lit("") if c in ("status", "metadata_json") else F.lit(-1)
        order.append(F.coalesce(F.col(c), low).alias(c))
    rows = memories.where("id IS NOT NULL").select("id", *dict.fromkeys([*columns, *_ORDER]))
    # a narrow hash aggregation finds the ids that repeat; only their rows are compared, the others pass unsorted
    repeated = rows.groupBy("id").agg(F.count("*").alias("__n")).where("__n > 1").select("id")
    once = rows.join(repeated, "id", "left_anti").select("id", *columns)
    chosen = rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r"))
    out = once.unionByName(chosen.select("id", "r.*"))
    if "status" in columns:
        out = out.withColumn("status", status_of(F.col("status")))
    if "kind" in columns:
        out = out.withColumn("kind", kind_of(F.col("kind")))
    return out


def live(now_ms: Column | int) -> Column:
    """Active and not expired at ``now_ms``."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return (F.col("status") == "active") & (F.col("expires_at_ms").isNull() | (F.col("expires_at_ms") > now))


def in_scope(tenant: str, namespace: str, agent: str | None = None, user: str | None = None) -> Column:
    """Tenant and namespace, which are required, and agent and user if given."""
    for name, value in (("tenant_id", tenant), ("namespace", namespace)):
        if not (value or "").strip():
            raise ValueError(f"{name} must not be empty")
    for name, value in (("agent_id", agent), ("user_id", user)):
        if value is not None and not value.strip():
            raise ValueError(f"{name} must not be empty if given")
    c = (F.col("tenant_id") == tenant.strip()) & (F.col("namespace") == namespace.strip())
    if agent is not None:
        c = c & (F.col("agent_id") == agent)
    return c if user is None else c & (F.col("user_id") == user)


def purgeable(records: DataFrame, now_ms: int) -> DataFrame:
    """Latest states that a vacuum may remove: deleted or expired."""
    return records.where((F.col("status") == "deleted") | (F.col("expires_at_ms") <= now_ms))


def vacuum_batch(records: DataFrame, now_ms: int, n: int) -> DataFrame:
    """The ``n`` oldest purgeable records (``id, updated_at_ms``); 0 gives none."""
    return purgeable(records, now_ms).select("id", "updated_at_ms").orderBy("updated_at_ms", "id").limit(max(n, 0))


def vacuumed(records: DataFrame, now_ms: int, n: int) -> DataFrame:
    """The records left after a vacuum of ``n``."""
    return records.join(vacuum_batch(records, now_ms, n).select("id"), "id", "left_anti")


def health(records: DataFrame, operations: DataFrame) -> DataFrame:
    """``active_records, tombstoned_records, pending_operations, is_healthy, rebuild_required``.

    The store is healthy if every active record can be indexed, i.e. has a usable embedding.
    Expired rows count as active until they are vacuumed. An operation counts once.
    """
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == F.col("embedding_dims"))
    counts = records.agg(
        F.count_if(F.col("status") == "active").alias("active_records"),
        F.count_if(F.col("status") == "deleted").alias("tombstoned_records"),
        F.count_if((F.col("status") == "active") & ~F.coalesce(usable, F.lit(False))).alias("unindexed"),
    )
    pending = F.countDistinct(F.when(trimmed_lower(F.col("state")) == "pending", F.col("operation_id")))
    ops = operations.agg(pending.alias("pending_operations"))
    one = counts.withColumn("one", F.lit(1)).join(ops.withColumn("one", F.lit(1)), "one")  # one row each
    return one.select("active_records", "tombstoned_records", "pending_operations", (F.col("unindexed") == 0).alias("is_healthy"), (F.col("unindexed") > 0).alias("rebuild_required"))
