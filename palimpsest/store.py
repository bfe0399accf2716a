"""A durable, multi-tenant record store on an append-only operation log of Parquet batches.

Layout below ``path``: ``log/<n>`` holds one committed batch each, ``snapshots/<n>`` the records
after batch n. A batch or snapshot counts once its ``_SUCCESS`` marker is there, which the Parquet
committer writes last; that is the atomic step, on any Hadoop file system. The current records are
the latest snapshot with later batches replayed: per field the latest value set after the latest
creation, one aggregation per record. An operation that was journalled as pending takes effect when
it is marked applied, also if snapshots were written in between. There must be a single writer at a
time; optimistic revision checks and idempotence are decided against the current records when a
batch is written. Small batches are written as one Parquet file without a Spark job; after
``COMPACT_BATCHES`` batches the records are written as a snapshot.

Manifests hold the layouts that the store has gone through; opening a store of an older layout
migrates it. Layout 2 has a content hash in every record.
"""

from __future__ import annotations

import io
import json
import time
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import validation
from .errors import StoreError
from .functions import scalars as S
from .operators import context, recall, records
from .sources.files import Folder

LOG = (
    "operation_id string, op string, state string, id string, tenant_id string, namespace string, agent_id string, user_id string, kind string, content string, "
    "content_hash bigint, embedding array<float>, embedding_model string, embedding_dims int, importance double, expires_at_ms bigint, sets_expiry boolean, "
    "metadata_json string, source_json string, revision bigint, at_ms bigint, seq bigint, status string"
)
_SET = ["tenant_id", "namespace", "agent_id", "user_id", "kind", "content", "content_hash", "embedding", "embedding_model", "embedding_dims", "importance", "metadata_json", "source_json"]
RECORD = (
    "id string, tenant_id string, namespace string, agent_id string, user_id string, kind string, content string, content_hash bigint, embedding array<float>, embedding_model string, "
    "embedding_dims int, importance double, created_at_ms bigint, updated_at_ms bigint, last_accessed_at_ms bigint, access_count bigint, expires_at_ms bigint, status string, "
    "revision bigint, metadata_json string, source_json string"
)
KEEP = object()  #: an update's expiry: leave it; None clears it
SCHEMA_VERSION = 2
COMPACT_BATCHES = 64
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<float>": pa.list_(pa.float32())}


def content_hash(text: str) -> int:
    """What ``xxhash64`` gives in SQL."""
    return int.from_bytes(xxhash.xxh64_digest(text.encode(), seed=42), "big", signed=True)


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, dimensions: int, embedding_model: str, max_recall_limit: int = 100, clock: Callable[[], int] | None = None):
        validation.config(dimensions, embedding_model, max_recall_limit)
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        self._last: int | None = None
        self.dims, self.model, self.max_recall_limit = dimensions, embedding_model, max_recall_limit
        self.now = clock or (lambda: int(time.time() * 1000))

    @classmethod
    def open(cls, spark: SparkSession, path: str, dimensions: int, embedding_model: str, max_recall_limit: int = 100, clock: Callable[[], int] | None = None) -> MemoryStore:
        """Open or create the store and finish what is pending."""
        store = cls(spark, path, dimensions, embedding_model, max_recall_limit, clock)
        store.migrate()
        store.recover()
        return store

    # --- layout -------------------------------------------------------------------------------
    def schema_version(self) -> int:
        """The latest layout that the store has gone through; 0 for a store that was never opened, 1 for data without a manifest."""
        found = self.folder.manifest()
        if found:
            return max(a["version"] for a in found["applied"])
        return 1 if self._committed("log") or self._committed("snapshots") else 0

    def migrate(self) -> int:
        """Bring the store to ``SCHEMA_VERSION``, one layout after the other; the version reached."""
        version = self.schema_version()
        if version > SCHEMA_VERSION:
            raise StoreError("INVALID_INPUT", f"the store has layout {version}, this library knows {SCHEMA_VERSION}")
        applied = (self.folder.manifest() or {"applied": []})["applied"]
        steps = {1: lambda: None, 2: self._fill_hashes}
        for v in range(version + 1, SCHEMA_VERSION + 1):
            if version:
                steps[v]()
            applied = [*applied, {"version": v, "at_ms": self.now()}]
        if version < SCHEMA_VERSION:
            self.folder.commit({"applied": applied})
        return SCHEMA_VERSION

    def _fill_hashes(self) -> None:
        """Layout 1 left the content hash of single writes empty."""
        missing = self.records().where("content_hash IS NULL AND content IS NOT NULL")
        if not missing.isEmpty():
            self._append(missing.select(F.uuid().alias("operation_id"), F.lit("status").alias("op"), F.lit("applied").alias("state"), "id", "tenant_id", "namespace",
                                        F.xxhash64("content").alias("content_hash"), "status", "revision", F.col("updated_at_ms").alias("at_ms")))

    # --- files --------------------------------------------------------------------------------
    def _committed(self, folder: str) -> list[int]:
        """Numbers of the batches or snapshots whose marker is there: one listing."""
        return self.folder.marked(folder)

    def _read(self, folder: str, numbers: list[int], schema: str) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{folder}/{n:09d}" for n in numbers])

    def _next(self) -> int:
        """The next batch's number; the folders are listed only if this isn't the writer of the last one."""
        n = self._last + 1 if self._last is not None else None
        if n is None or self.folder.exists(f"log/{n:09d}"):
            n = max([0, *map(int, filter(str.isdigit, self.folder.names("log"))), *self._committed("snapshots")]) + 1
        self._last = n
        return n

    def _append(self, rows: DataFrame) -> int:
        seq = self._next()
        columns = [c.split()[0] for c in LOG.split(", ")]
        there = set(rows.columns)
        types = dict(c.split(maxsplit=1) for c in LOG.split(", "))
        rows = rows.withColumn("seq", F.lit(seq)).select(
            *[(F.col(c) if c in there or c == "seq" else F.lit(None)).cast(types[c]).alias(c) for c in columns]
        )
        rows.write.mode("errorifexists").parquet(f"{self.path}/log/{seq:09d}")
        self._tidy(seq)
        return seq

    def _append_rows(self, rows: list[dict]) -> int:
        """One Parquet file, then the marker: no Spark job."""
        seq = self._next()
        types = dict(c.split(maxsplit=1) for c in LOG.split(", "))
        table = pa.table({n: pa.array([seq if n == "seq" else r.get(n) for r in rows], _ARROW[t]) for n, t in types.items()})
        sink = io.BytesIO()
        pq.write_table(table, sink)
        self.folder.put(f"log/{seq:09d}/part-00000.parquet", sink.getvalue())
        self.folder.put(f"log/{seq:09d}/_SUCCESS", b"")
        self._tidy(seq)
        return seq

    def _tidy(self, seq: int) -> None:
        """Compact now and then, so that reading stays a few batches behind a snapshot."""
        if seq % COMPACT_BATCHES == 0:
            self.compact()

    def log(self) -> DataFrame:
        """All committed operations, as appended."""
        return self._read("log", self._committed("log"), LOG)

    def compact(self) -> None:
        """Write a snapshot of the current records; older batches stay as history."""
        log, snaps = self._committed("log"), self._committed("snapshots")
        if log and (not snaps or log[-1] > snaps[-1]):
            self.records().write.mode("overwrite").parquet(f"{self.path}/snapshots/{log[-1]:09d}")

    # --- replay -------------------------------------------------------------------------------
    def records(self) -> DataFrame:
        """The current records, deleted ones included until they are vacuumed."""
        snaps = self._committed("snapshots")
        base = self._read("snapshots", snaps[-1:], RECORD)
        batches = self._committed("log")
        later = [n for n in batches if not snaps or n > snaps[-1]]
        ops = self._read("log", later, LOG)
        earlier = self._read("log", [n for n in batches if n not in set(later)], LOG).where("state = 'pending'")
        marks = ops.where("op = 'mark'").groupBy("operation_id").agg(F.min("seq").alias("marked"))
        pending = ops.where("op <> 'mark' AND state = 'pending'").unionByName(earlier).join(marks, "operation_id").withColumn("seq", F.col("marked")).drop("marked")
        ops = ops.where("op <> 'mark' AND state = 'applied'").unionByName(pending)
        started = base.select(
            F.lit("snapshot").alias("op"), F.lit(-1).cast("bigint").alias("seq"), "id", *_SET, "expires_at_ms", F.lit(True).alias("sets_expiry"), "revision",
            F.col("updated_at_ms").alias("at_ms"), "created_at_ms", "status", "access_count", "last_accessed_at_ms",
        )
        events = started.unionByName(
            ops.select("op", "seq", "id", *_SET, "expires_at_ms", "sets_expiry", "revision", "at_ms", F.when(F.col("op") == "remember", F.col("at_ms")).alias("created_at_ms"), "status",
                       F.when(F.col("op") == "remember", F.lit(0)).cast("bigint").alias("access_count"), F.lit(None).cast("bigint").alias("last_accessed_at_ms"))
        )
        order = F.col("seq")
        status = F.when(F.col("op").isin("snapshot", "status"), F.col("status")).when(F.col("op") == "delete", "deleted").otherwise("active")

        def last(value, when) -> F.Column:
            return F.max_by(F.struct(order.alias("seq"), value.alias("v")), F.when(when, order))

        found = events.groupBy("id").agg(
            F.max_by(F.struct(order.alias("seq"), "op"), F.when(F.col("op").isin("snapshot", "remember", "purge"), order)).alias("start"),
            *[last(F.col(c), F.col(c).isNotNull() | (F.col("op").isin("snapshot", "remember"))).alias(c) for c in [*_SET, "created_at_ms", "access_count", "last_accessed_at_ms", "revision"]],
            last(F.col("expires_at_ms"), F.col("sets_expiry") | F.col("op").isin("snapshot", "remember")).alias("expires_at_ms"),
            last(status, F.lit(True)).alias("status"),
            last(F.col("at_ms"), F.lit(True)).alias("updated_at_ms"),
        )
        names = [c.split()[0] for c in RECORD.split(", ")]
        values = [F.col("id") if n == "id" else F.when(F.col(f"{n}.seq") >= F.col("start.seq"), F.col(f"{n}.v")).alias(n) for n in names]
        return found.where("start.op <> 'purge'").select(*values)

    def active(self) -> DataFrame:
        return self.records().where("status = 'active'")

    # --- writing ------------------------------------------------------------------------------
    def _known(self, tenant: str, operation_ids: list[str]) -> dict[str, str]:
        """Memory ids of operations that are in the log."""
        if not operation_ids:
            return {}
        rows = self.log().where((F.col("tenant_id") == tenant) & F.col("operation_id").isin(operation_ids) & (F.col("op") == "remember"))
        return {r["operation_id"]: r["id"] for r in rows.select("operation_id", "id").collect()}

    def _row(self, r: dict, state: str = "applied") -> dict:
        tenant, namespace, agent, user = validation.scope(r.get("tenant_id"), r.get("namespace"), r.get("agent_id"), r.get("user_id"))
        if r.get("embedding_model") not in (None, self.model):
            raise StoreError("EMBEDDING_MODEL_MISMATCH", f"this store holds embeddings of {self.model}, not of {r['embedding_model']}")
        kind = str(r.get("kind") or "fact").strip().lower()
        text = validation.content(r["content"])
        return {
            "operation_id": r.get("operation_id") or str(uuid.uuid4()), "op": "remember", "state": state, "id": str(uuid.uuid4()),
            "tenant_id": tenant, "namespace": namespace, "agent_id": agent, "user_id": user, "kind": kind if kind in records.KINDS else "episodic",
            "content": text, "content_hash": content_hash(text), "embedding": validation.vector(r["embedding"], self.dims), "embedding_model": self.model, "embedding_dims": self.dims,
            "importance": validation.importance(r.get("importance", 0.5)), "expires_at_ms": r.get("expires_at_ms"), "sets_expiry": True,
            "metadata_json": validation.metadata(r.get("metadata")), "source_json": json.dumps(r.get("source") or {}), "revision": 1, "at_ms": self.now(),
        }

    def remember(self, tenant_id: str, namespace: str, content: str, embedding: Any, kind: str = "fact", importance: float = 0.5, **more: Any) -> str:
        """Store a record; with an ``operation_id`` seen before in the tenant, the id given then."""
        return self.remember_batch([{"tenant_id": tenant_id, "namespace": namespace, "content": content, "embedding": embedding, "kind": kind, "importance": importance, **more}])[0]

    def remember_batch(self, items: list[dict], state: str = "applied") -> list[str]:
        """Store all records or none; ids in the order given; the first record of an operation id wins."""
        for r in items:
            for needed in ("tenant_id", "namespace", "content", "embedding"):
                if needed not in r:
                    raise StoreError("INVALID_INPUT", f"a record needs {needed}")
        rows = [self._row(r, state) for r in items]
        known: dict[tuple, str] = {}
        for tenant in {r["tenant_id"] for r in rows}:
            given = [r["operation_id"] for r, i in zip(rows, items) if r["tenant_id"] == tenant and i.get("operation_id")]
            known |= {(tenant, o): i for o, i in self._known(tenant, given).items()}
        out, fresh = [], []
        for r in rows:
            key = (r["tenant_id"], r["operation_id"])
            if key not in known:
                known[key] = r["id"]
                fresh.append(r)
            out.append(known[key])
        if fresh:
            self._append_rows(fresh)
        return out

    def remember_frame(self, rows: DataFrame) -> DataFrame:
        """Store a DataFrame in one distributed batch; the rejected rows come back with a ``reason``.

        Columns as in ``remember_batch``, metadata as ``metadata_json``; operations already in the log
        are left out, and of those repeated within the frame the row with the smallest fields is kept.
        """
        rows = rows.select(*[c for c in ("tenant_id", "namespace", "content", "embedding", "operation_id", "agent_id", "user_id", "kind", "importance", "expires_at_ms", "metadata_json", "source_json") if c in rows.columns])
        for c in ("operation_id", "agent_id", "user_id", "kind", "importance", "expires_at_ms", "metadata_json", "source_json"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None))
        importance = F.coalesce(F.col("importance").cast("double"), F.lit(0.5))
        reason = (
            F.when(F.coalesce(F.btrim("tenant_id"), F.lit("")) == "", "INVALID_SCOPE").when(F.coalesce(F.btrim("namespace"), F.lit("")) == "", "INVALID_SCOPE")
            .when(F.coalesce(F.btrim("content"), F.lit("")) == "", "INVALID_INPUT").when(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dims, "DIMENSION_MISMATCH")
            .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "INVALID_INPUT").when(~importance.between(0, 1), "INVALID_INPUT")
        )
        judged = rows.withColumn("reason", reason)
        good = judged.where("reason IS NULL").withColumn("operation_id", F.coalesce(F.col("operation_id").cast("string"), F.uuid()))
        good = good.withColumn("tenant_id", F.btrim("tenant_id"))
        rest = [c for c in good.columns if c not in ("tenant_id", "operation_id")]
        good = good.groupBy("tenant_id", "operation_id").agg(F.min(F.struct(*rest)).alias("r")).select("tenant_id", "operation_id", "r.*")
        seen = self.log().where("op = 'remember'").select("tenant_id", "operation_id").distinct()
        good = good.join(seen, ["tenant_id", "operation_id"], "left_anti")
        self._append(
            good.select(
                "operation_id", F.lit("remember").alias("op"), F.lit("applied").alias("state"), F.uuid().alias("id"), "tenant_id", F.btrim("namespace").alias("namespace"),
                "agent_id", "user_id", records.kind_of(F.coalesce(F.col("kind").cast("string"), F.lit("fact"))).alias("kind"), "content", F.xxhash64("content").alias("content_hash"),
                "embedding", F.lit(self.model).alias("embedding_model"), F.lit(self.dims).alias("embedding_dims"), importance.alias("importance"), "expires_at_ms", F.lit(True).alias("sets_expiry"),
                F.coalesce(F.col("metadata_json").cast("string"), F.lit("{}")).alias("metadata_json"), F.coalesce(F.col("source_json").cast("string"), F.lit("{}")).alias("source_json"),
                F.lit(1).alias("revision"), F.lit(self.now()).alias("at_ms"),
            )
        )
        return judged.where("reason IS NOT NULL")

    def _one(self, tenant_id: str, namespace: str, id: str) -> Any:
        tenant, ns, _, _ = validation.scope(tenant_id, namespace)
        return self.records().where((F.col("id") == validation.identifier(id)) & (F.col("tenant_id") == tenant) & (F.col("namespace") == ns)).first()

    def update(self, tenant_id: str, namespace: str, id: str, expected_revision: int, content: str | None = None, embedding: Any = None, kind: str | None = None,
               importance: float | None = None, expires_at_ms: Any = KEEP, metadata_patch: dict | None = None, operation_id: str | None = None) -> int:
        """Change a record if it still has the expected revision; the new revision."""
        now = self._one(tenant_id, namespace, id)
        if now is None or now["status"] == "deleted":
            raise StoreError("NOT_FOUND", f"no record {id}")
        if now["revision"] != expected_revision:
            raise StoreError("REVISION_CONFLICT", f"expected {expected_revision}, found {now['revision']}")
        row = {"operation_id": operation_id or str(uuid.uuid4()), "op": "update", "state": "applied", "id": now["id"], "tenant_id": now["tenant_id"], "namespace": now["namespace"], "revision": expected_revision + 1, "at_ms": self.now()}
        if content is not None:
            row |= {"content": validation.content(content), "content_hash": content_hash(content)}
        if embedding is not None:
            row["embedding"] = validation.vector(embedding, self.dims)
        if kind is not None:
            row["kind"] = kind.strip().lower() if kind.strip().lower() in records.KINDS else "episodic"
        if importance is not None:
            row["importance"] = validation.importance(importance)
        if expires_at_ms is not KEEP:
            row |= {"expires_at_ms": expires_at_ms, "sets_expiry": True}
        if metadata_patch:
            merged = json.loads(now["metadata_json"] or "{}") | json.loads(validation.metadata(metadata_patch))
            row["metadata_json"] = json.dumps(merged, ensure_ascii=False)
        self._append_rows([row])
        return expected_revision + 1

    def update_frame(self, patches: DataFrame) -> DataFrame:
        """Apply patches (``id, tenant_id, namespace, expected_revision`` and fields) in one batch; rejects come back.

        Of several patches of a record only one can have the expected revision and is applied, the
        smallest by its fields; the others are conflicts.
        """
        types = {"content": "string", "embedding": "array<float>", "kind": "string", "importance": "double"}
        fields = [c for c in types if c in patches.columns]
        current = self.records().select("id", F.col("tenant_id").alias("t"), F.col("namespace").alias("n"), F.col("status").alias("s"), F.col("revision").alias("r"))
        one = patches.groupBy("id", "tenant_id", "namespace", "expected_revision").agg(F.min(F.struct(*fields)).alias("p"), F.count("*").alias("k"))
        joined = one.join(current, "id", "left")

        def given(c: str) -> F.Column:
            return F.col(f"p.{c}").cast(types[c]) if c in fields else F.lit(None).cast(types[c])

        missing = F.col("r").isNull() | (F.col("s") == "deleted") | (F.col("t") != F.col("tenant_id")) | (F.col("n") != F.col("namespace"))
        reason = (
            F.when(missing, "NOT_FOUND").when(F.col("r") != F.col("expected_revision"), "REVISION_CONFLICT")
            .when(F.btrim(given("content")) == "", "INVALID_INPUT").when(F.size(given("embedding")) != self.dims, "DIMENSION_MISMATCH")
            .when(F.exists(given("embedding"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "INVALID_INPUT").when(~given("importance").between(0, 1), "INVALID_INPUT")
        )
        judged = joined.withColumn("reason", reason)
        good = judged.where("reason IS NULL")
        values = [(F.when(given(c).isNotNull(), records.kind_of(given(c))) if c == "kind" else given(c)).alias(c) for c in fields]
        self._append(
            good.select(F.uuid().alias("operation_id"), F.lit("update").alias("op"), F.lit("applied").alias("state"), "id", "tenant_id", "namespace", *values,
                        F.when(given("content").isNotNull(), F.xxhash64(given("content"))).alias("content_hash"), (F.col("expected_revision") + 1).alias("revision"), F.lit(self.now()).alias("at_ms"))
        )
        return judged.where("reason IS NOT NULL OR k > 1").select("id", "expected_revision", F.coalesce("reason", F.lit("REVISION_CONFLICT")).alias("reason"))

    def forget(self, tenant_id: str, namespace: str, id: str) -> None:
        """Mark a record deleted; an id that isn't in the scope is no error and changes nothing."""
        self.forget_batch(tenant_id, namespace, [id])

    def forget_batch(self, tenant_id: str, namespace: str, ids: list[str]) -> None:
        tenant, ns, _, _ = validation.scope(tenant_id, namespace)
        wanted = [validation.identifier(i) for i in ids]
        if not wanted:
            return
        hit = self.records().where(F.col("id").isin(wanted) & (F.col("tenant_id") == tenant) & (F.col("namespace") == ns) & (F.col("status") != "deleted"))
        self._append(hit.select(F.uuid().alias("operation_id"), F.lit("delete").alias("op"), F.lit("applied").alias("state"), "id", "tenant_id", "namespace", "revision", F.lit(self.now()).alias("at_ms")))

    def forget_frame(self, rows: DataFrame) -> None:
        """As ``forget_batch``, for any number of ``id, tenant_id, namespace`` in one distributed batch."""
        wanted = rows.select("id", F.btrim("tenant_id").alias("tenant_id"), F.btrim("namespace").alias("namespace")).distinct()
        hit = self.records().where("status <> 'deleted'").join(wanted, ["id", "tenant_id", "namespace"], "left_semi")
        self._append(hit.select(F.uuid().alias("operation_id"), F.lit("delete").alias("op"), F.lit("applied").alias("state"), "id", "tenant_id", "namespace", "revision", F.lit(self.now()).alias("at_ms")))

    def set_status(self, id: str, status: str) -> None:
        self.set_status_batch([id], status)

    def set_status_batch(self, ids: list[str], status: str) -> None:
        """Give records a status, in whatever scope they are, revision and times unchanged; unknown ids change nothing."""
        if status not in records.STATUSES:
            raise StoreError("INVALID_INPUT", f"no status {status!r}")
        wanted = [validation.identifier(i) for i in ids]
        if wanted:
            hit = self.records().where(F.col("id").isin(wanted)).select("id", "tenant_id", "namespace", "revision", "updated_at_ms").collect()
            rows = [{"operation_id": str(uuid.uuid4()), "op": "status", "state": "applied", "status": status, "at_ms": r["updated_at_ms"], **{c: r[c] for c in ("id", "tenant_id", "namespace", "revision")}} for r in hit]
            if rows:
                self._append_rows(rows)

    def mark_applied(self, operation_ids: list[str]) -> None:
        self._append_rows([{"operation_id": o, "op": "mark", "state": "applied", "at_ms": self.now()} for o in operation_ids])

    # --- lifecycle ----------------------------------------------------------------------------
    def pending(self) -> DataFrame:
        """Operations journalled but not applied, oldest first."""
        log = self.log()
        done = log.where("op = 'mark'").select("operation_id").distinct()
        return log.where("state = 'pending'").join(done, "operation_id", "left_anti").orderBy("at_ms", "operation_id")

    def recover(self) -> int:
        """Apply what is pending; how many operations that were."""
        open_ = self.pending()
        n = open_.count()
        if n:
            self._append(open_.select("operation_id", F.lit("mark").alias("op"), F.lit("applied").alias("state"), F.lit(self.now()).alias("at_ms")))
        return n

    def vacuum_tombstones(self, batch_size: int = 100) -> int:
        """Remove at most ``batch_size`` deleted or expired records, oldest first; how many went."""
        if batch_size <= 0:
            return 0
        gone = records.vacuum_batch(self.records(), self.now(), batch_size)
        n = gone.count()
        if n:
            self._append(gone.select(F.uuid().alias("operation_id"), F.lit("purge").alias("op"), F.lit("applied").alias("state"), "id", F.lit(self.now()).alias("at_ms")))
            self.compact()
        return n

    def rebuild_index(self) -> None:
        """Derived data is computed from the records; rebuilding is writing a fresh snapshot."""
        self.compact()

    def health(self) -> dict:
        ops = self.log().where("op <> 'mark'").select("operation_id", "state")
        done = self.log().where("op = 'mark'").select("operation_id", F.lit("applied").alias("state"))
        states = ops.unionByName(done).groupBy("operation_id").agg(F.min("state").alias("state"))
        h = records.health(self.records(), states).first().asDict()
        size = {folder: self.folder.size(folder) for folder in ("snapshots", "log")}
        return {
            "is_healthy": h["is_healthy"], "total_active_records": h["active_records"], "total_tombstoned_records": h["tombstoned_records"],
            "pending_operations_count": h["pending_operations"], "index_rebuild_required": h["rebuild_required"], "db_size_bytes": size["snapshots"], "wal_size_bytes": size["log"],
        }

    def integrity_check(self) -> bool:
        """Whether every record has an id, a scope and a vector of the right length."""
        bad = self.records().where(f"id IS NULL OR tenant_id IS NULL OR namespace IS NULL OR coalesce(size(embedding), -1) <> {self.dims}")
        return bad.limit(1).count() == 0

    def backup(self, target: str) -> None:
        """A store at ``target`` with the records and all operations as they are now: known ones stay known, pending ones pending."""
        log, copy = self._committed("log"), Folder(self.spark, target)
        if copy.names("log") or copy.names("snapshots"):
            raise StoreError("INVALID_INPUT", f"{target} is not empty")
        last = max([0, *log])
        if log:
            self._read("log", log, LOG).write.parquet(f"{copy.path}/log/{last:09d}")
        self.records().write.parquet(f"{copy.path}/snapshots/{last:09d}")
        found = self.folder.manifest()
        if found:
            copy.commit(found)

    # --- reading ------------------------------------------------------------------------------
    def get_raw(self, tenant_id: str, namespace: str, id: str) -> dict | None:
        row = self._one(tenant_id, namespace, id)
        return row.asDict() if row else None

    def find(self, id: str) -> dict | None:
        """A record of any scope and status, for recovery and tools."""
        row = self.records().where(F.col("id") == validation.identifier(id)).first()
        return row.asDict() if row else None

    def get(self, tenant_id: str, namespace: str, id: str) -> dict | None:
        """An active record, whether or not it has expired."""
        row = self.get_raw(tenant_id, namespace, id)
        keep = ("id", "content", "importance", "created_at_ms", "updated_at_ms", "access_count", "expires_at_ms", "status", "revision")
        return {k: row[k] for k in keep} if row and row["status"] == "active" else None

    def _request(self, tenant_id: str, namespace: str, query_embedding: Any, query_text: str | None, limit: int, mmr_lambda: float | None, filter_metadata: dict | None, kinds: list[str] | None, min_importance: float | None) -> DataFrame:
        tenant, ns, _, _ = validation.scope(tenant_id, namespace)
        meta = validation.metadata(filter_metadata) if filter_metadata else None
        row = ("q", tenant, ns, None, None, validation.vector(query_embedding, self.dims), query_text, validation.limit(limit), kinds, min_importance, meta, validation.mmr_lambda(mmr_lambda), self.now())
        schema = (
            "request_id string, tenant_id string, namespace string, agent_id string, user_id string, query_embedding array<float>, query_text string, max_items int, kinds array<string>, "
            "min_importance double, metadata_eq_json string, mmr_lambda double, asked_at_ms bigint"
        )
        return self.spark.createDataFrame([row], schema)

    def recall(self, tenant_id: str, namespace: str, query_embedding: Any, query_text: str | None = None, limit: int = 5, mmr_lambda: float | None = None,
               filter_metadata: dict | None = None, kinds: list[str] | None = None, min_importance: float | None = None) -> list[tuple[str, str, float]]:
        """The best records as (id, content, score)."""
        r = self._request(tenant_id, namespace, query_embedding, query_text, limit, mmr_lambda, filter_metadata, kinds, min_importance)
        return [(x["id"], x["content"], x["score"]) for x in self.recall_batch(r).orderBy("position").collect()]

    def recall_batch(self, requests: DataFrame) -> DataFrame:
        """Any number of requests in one plan (see ``operators.recall``)."""
        return recall.recall(requests, self.records(), self.dims, self.max_recall_limit)

    def format_context(self, tenant_id: str, namespace: str, query_embedding: Any, query_text: str | None = None, max_tokens: int = 1500, limit: int = 10,
                       template: str | None = None, header: str | None = None, footer: str | None = None, filter_metadata: dict | None = None) -> str:
        r = self._request(tenant_id, namespace, query_embedding, query_text, limit, 0.5, filter_metadata, None, None)
        head = context.HEADER if header is None else header
        found = self.recall_batch(r).select("qid", "position", "kind", "content", "score")
        rows = context.contexts(found, max_tokens, template or context.TEMPLATE, head, footer).collect()
        if rows:
            return rows[0]["context"]
        start = head + "\n" if head else ""
        return start + (footer if footer and context._estimate(start) + context._estimate(footer) <= max_tokens else "")
