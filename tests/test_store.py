import pytest
from pyspark.sql import functions as F

from palimpsest.errors import StoreError
from palimpsest.store import MemoryStore
from palimpsest.streaming import ingest

from .frames import operations


class Clock:
    now = 1_700_000_000_000

    def __call__(self):
        Clock.now += 1
        return Clock.now


@pytest.fixture()
def store(spark, tmp_path):
    return MemoryStore.open(spark, str(tmp_path / "store"), 3, "m", clock=Clock())


def test_life_of_a_record(store):
    a = store.remember("t", "n", "hello world", [1, 0, 0], operation_id="op", metadata={"p": "x"})
    assert store.remember("t", "n", "again", [1, 0, 0], operation_id="op") == a
    assert store.remember("u", "n", "other tenant", [1, 0, 0], operation_id="op") != a
    assert store.get("t", "n", a)["revision"] == 1 and store.get("u", "n", a) is None
    with pytest.raises(StoreError, match="REVISION_CONFLICT"):
        store.update("t", "n", a, 99, content="no")
    assert store.update("t", "n", a, 1, content="changed", kind="preference", metadata_patch={"q": 1}) == 2
    raw = store.get_raw("t", "n", a)
    assert (raw["content"], raw["kind"], raw["revision"], raw["metadata_json"]) == ("changed", "preference", 2, '{"p": "x", "q": 1}')
    assert raw["embedding"] == [1.0, 0.0, 0.0]
    assert store.recall("t", "n", [1, 0, 0], filter_metadata={"q": 1})[0][0] == a
    assert store.recall("t", "n", [1, 0, 0], filter_metadata={"q": "1"}) == []
    text = store.format_context("t", "n", [1, 0, 0], "changed")
    assert text.startswith("### Relevant Agent Memories:\n- [preference] changed")
    store.forget("u", "n", a)
    assert store.get("t", "n", a) is not None
    store.forget("t", "n", a)
    store.forget("t", "n", "missing")
    assert store.get("t", "n", a) is None and store.get_raw("t", "n", a)["status"] == "deleted"
    with pytest.raises(StoreError, match="NOT_FOUND"):
        store.update("t", "n", a, 2, content="x")
    store.compact()
    assert store.get_raw("t", "n", a)["content"] == "changed"
    assert store.integrity_check()


def test_batch_vacuum_health_backup(spark, store, tmp_path):
    ids = store.remember_batch([{"tenant_id": "t", "namespace": "n", "content": f"c{i}", "embedding": [1, i, 0]} for i in range(5)])
    assert len(set(ids)) == 5
    store.forget_batch("t", "n", ids[:3])
    h = store.health()
    assert (h["total_active_records"], h["total_tombstoned_records"], h["pending_operations_count"], h["is_healthy"]) == (2, 3, 0, True)
    assert [store.vacuum_tombstones(0), store.vacuum_tombstones(2), store.vacuum_tombstones(10), store.vacuum_tombstones(10)] == [0, 2, 1, 0]
    assert store.health()["total_active_records"] == 2 and store.health()["total_tombstoned_records"] == 0
    store.backup(str(tmp_path / "copy"))
    assert MemoryStore.open(spark, str(tmp_path / "copy"), 3, "m").active().count() == 2


def test_backup_keeps_operations(spark, store, tmp_path):
    a = store.remember("t", "n", "first", [1, 0, 0], operation_id="known")
    (b,) = store.remember_batch([{"tenant_id": "t", "namespace": "n", "content": "later", "embedding": [0, 1, 0]}], state="pending")
    store.backup(str(tmp_path / "copy"))
    with pytest.raises(StoreError):
        store.backup(str(tmp_path / "copy"))
    copy = MemoryStore(spark, str(tmp_path / "copy"), 3, "m", clock=Clock())
    assert copy.pending().count() == 1 and copy.active().count() == 1
    assert copy.remember("t", "n", "again", [1, 0, 0], operation_id="known") == a and copy.active().count() == 1
    assert copy.recover() == 1 and copy.get("t", "n", b)["content"] == "later" and copy.schema_version() == 2
    copy.compact()
    assert copy.active().count() == 2 and store.active().count() == 1


def test_pending_before_a_snapshot(store):
    store.remember("t", "n", "one", [1, 0, 0])
    (b,) = store.remember_batch([{"tenant_id": "t", "namespace": "n", "content": "two", "embedding": [0, 1, 0], "operation_id": "p"}], state="pending")
    store.compact()
    store.mark_applied(["p"])
    assert store.get("t", "n", b)["content"] == "two"
    store.compact()
    assert store.active().count() == 2


def test_content_hash_status_and_compaction(spark, store, monkeypatch):
    monkeypatch.setattr("palimpsest.store.COMPACT_BATCHES", 4)
    a = store.remember("t", "n", "grüße", [1, 0, 0])
    hashed = store.records().select(F.expr("content_hash = xxhash64(content)").alias("same"))
    assert hashed.first()["same"]
    store.update("t", "n", a, 1, content="other")
    assert hashed.first()["same"] and store.find(a)["revision"] == 2 and store.find("none") is None
    patch = spark.createDataFrame([(a, "t", "n", 2, "third")], "id string, tenant_id string, namespace string, expected_revision bigint, content string")
    assert store.update_frame(patch).count() == 0
    assert store.records().select(F.expr("content_hash = xxhash64(content)").alias("same")).first()["same"]
    before = store.find(a)
    store.set_status(a, "expired")
    store.set_status_batch(["none"], "active")
    after = store.find(a)
    assert after["status"] == "expired" and {k: v for k, v in before.items() if k != "status"} == {k: v for k, v in after.items() if k != "status"}
    with pytest.raises(StoreError):
        store.set_status(a, "odd")
    assert store._committed("snapshots") == [4]
    store.set_status(a, "active")
    assert store.get("t", "n", a)["content"] == "third"


def test_update_frame_rejects_what_a_single_update_does(spark, store):
    ids = store.remember_batch([{"tenant_id": "t", "namespace": "n", "content": f"c{i}", "embedding": [1, i, 0]} for i in range(5)])
    rows = [(ids[0], "t", "n", 1, " ", None, None), (ids[1], "t", "n", 1, None, [1.0], None), (ids[2], "t", "n", 1, None, [1.0, float("nan"), 0.0], None), (ids[3], "t", "n", 1, None, None, 2.0), (ids[4], "t", "n", 1, "ok", [0.0, 0.0, 1.0], 0.5)]
    patches = spark.createDataFrame(rows, "id string, tenant_id string, namespace string, expected_revision bigint, content string, embedding array<float>, importance double")
    got = {r["id"]: r["reason"] for r in store.update_frame(patches).collect()}
    assert got == dict(zip(ids, ["INVALID_INPUT", "DIMENSION_MISMATCH", "INVALID_INPUT", "INVALID_INPUT"]))
    assert store.find(ids[4])["embedding"] == [0.0, 0.0, 1.0] and store.find(ids[0])["revision"] == 1


def test_migration_fills_hashes(spark, tmp_path):
    old = MemoryStore(spark, str(tmp_path / "old"), 3, "m", clock=Clock())
    assert old.schema_version() == 0
    row = old._row({"tenant_id": "t", "namespace": "n", "content": "x", "embedding": [1, 0, 0]}) | {"content_hash": None}
    old._append_rows([row])
    assert old.schema_version() == 1
    new = MemoryStore.open(spark, str(tmp_path / "old"), 3, "m", clock=Clock())
    assert new.schema_version() == 2 and [a["version"] for a in new.folder.manifest()["applied"]] == [2]
    r = new.find(row["id"])
    assert r["content_hash"] is not None and r["revision"] == 1 and r["updated_at_ms"] == r["created_at_ms"]
    new.folder.commit({"applied": [{"version": 9, "at_ms": 0}]})
    with pytest.raises(StoreError):
        MemoryStore.open(spark, str(tmp_path / "old"), 3, "m")


def test_recovery(spark, store):
    (a,) = store.remember_batch([{"tenant_id": "t", "namespace": "n", "content": "x", "embedding": [1, 0, 0]}], state="pending")
    assert store.get("t", "n", a) is None and store.health()["pending_operations_count"] == 1
    again = MemoryStore.open(spark, store.path, 3, "m", clock=Clock())
    assert again.get("t", "n", a)["content"] == "x" and again.recover() == 0


def test_expiry_is_kept_set_and_cleared(store):
    a = store.remember("t", "n", "x", [1, 0, 0], expires_at_ms=5)
    assert store.get("t", "n", a)["expires_at_ms"] == 5 and store.recall("t", "n", [1, 0, 0]) == []
    store.update("t", "n", a, 1, importance=0.9)
    assert store.get("t", "n", a)["expires_at_ms"] == 5
    store.update("t", "n", a, 2, expires_at_ms=None)
    assert store.get("t", "n", a)["expires_at_ms"] is None and len(store.recall("t", "n", [1, 0, 0])) == 1


def test_frames(spark, store):
    rows = spark.createDataFrame(
        [("t", "n", "a", [1.0, 0.0, 0.0], "o1"), ("t", "n", "b", [1.0], "o2"), (" ", "n", "c", [1.0, 0.0, 0.0], "o3"), ("t", "n", None, [1.0, 0.0, 0.0], "o4"), ("t", "n", "dup", [1.0, 0.0, 0.0], "o1")],
        "tenant_id string, namespace string, content string, embedding array<float>, operation_id string",
    )
    rejected = {r["operation_id"]: r["reason"] for r in store.remember_frame(rows).collect()}
    assert rejected == {"o2": "DIMENSION_MISMATCH", "o3": "INVALID_SCOPE", "o4": "INVALID_INPUT"}
    store.remember_frame(rows)
    assert store.active().count() == 1
    rec = store.active().first()
    patches = spark.createDataFrame([(rec["id"], "t", "n", 1, "new"), ("zz", "t", "n", 1, "x"), (rec["id"], "t", "n", 7, "y")], "id string, tenant_id string, namespace string, expected_revision bigint, content string")
    assert {(r["id"], r["reason"]) for r in store.update_frame(patches).collect()} >= {("zz", "NOT_FOUND"), (rec["id"], "REVISION_CONFLICT")}
    assert store.get("t", "n", rec["id"])["content"] == "new"


@pytest.mark.parametrize("bad", [{"tenant_id": " "}, {"content": " "}, {"embedding": [1.0]}, {"importance": 2}, {"metadata": {"a": []}}, {"agent_id": ""}, {"embedding_model": "other"}])
def test_validation(store, bad):
    good = {"tenant_id": "t", "namespace": "n", "content": "c", "embedding": [1, 0, 0]}
    with pytest.raises(ValueError, match=r"^\["):
        store.remember_batch([good | bad])
    assert store.log().count() == 0


def test_config(spark, tmp_path):
    for dims, model in ((0, "m"), (3, " "), (None, "m")):
        with pytest.raises(StoreError):
            MemoryStore.open(spark, str(tmp_path), dims, model)


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed = operations(spark, [("a", "m", " Remember", None, "applied", 1000, None), ("a", "m", "remember", None, "applied", 1000, None), (None, "m", "update", None, None, 5, None), ("b", "m", "delete", None, None, 2000, None)])
    feed.drop("seq", "rank").write.parquet(src)
    q = ingest.append_to_log(ingest.operations_stream(spark, src), out, str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(out)
    assert sorted((r["operation_id"], r["kind"]) for r in got.collect()) == [("a", "remember"), ("b", "delete")]
    timed = got.withColumn("ts", F.timestamp_millis("created_at_ms"))
    assert ingest.counts_by_window(timed).count() == 2
