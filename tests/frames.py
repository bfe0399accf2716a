"""Small tables in the shapes of the store's tables, with columns whose names clash with internal ones."""

MEMORY = (
    "id string, tenant_id string, namespace string, agent_id string, user_id string, kind string, content string, content_hash bigint, embedding array<float>, embedding_model string, "
    "embedding_dims int, importance double, created_at_ms bigint, updated_at_ms bigint, last_accessed_at_ms bigint, access_count bigint, expires_at_ms bigint, status string, "
    "revision bigint, metadata_json string, source_json string, rank int, n int, score double, key string, block int, t string, s int, v double, token string"
)
NAMES = [c.split()[0] for c in MEMORY.split(", ")]
DEFAULT = {"tenant_id": "t", "namespace": "n", "kind": "fact", "content": "x", "importance": 0.5, "created_at_ms": 1_700_000_000_000, "updated_at_ms": 1_700_000_000_000, "access_count": 0, "status": "active", "revision": 1}


def memories(spark, rows):
    full = []
    for r in rows:
        r = DEFAULT | r
        if r.get("embedding") is not None and "embedding_dims" not in r:
            r["embedding_dims"] = len(r["embedding"])
        full.append(tuple(r.get(c) for c in NAMES))
    return spark.createDataFrame(full, MEMORY)


OPERATION = "operation_id string, memory_id string, kind string, payload_json string, state string, created_at_ms bigint, applied_at_ms bigint, seq int, rank int"


def operations(spark, rows):
    return spark.createDataFrame([tuple(list(r) + [None] * (9 - len(r))) for r in rows], OPERATION)


SNAPSHOT = "snapshot_at_ms bigint, id string, tenant_id string, namespace string, revision bigint, importance double, status string, updated_at_ms bigint, state string, leaf int"


def snapshots(spark, rows):
    return spark.createDataFrame([tuple(list(r) + [None] * (10 - len(r))) for r in rows], SNAPSHOT)


DOCUMENT = "doc_id bigint, text string, lang string, source string, tokens int, copies int, at double, piece int"


def documents(spark, rows):
    return spark.createDataFrame([tuple(list(r) + [None] * (8 - len(r))) for r in rows], DOCUMENT)
