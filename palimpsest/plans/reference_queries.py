"""Catalogue of the engine's own queries, by operator group."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.metrics import METRICS, distance
from ..functions.text import query_phrases
from ..index import Index
from ..operators import context, filters, fulltext, ivf, knn, oplog, recall, records
from ..operators.durable import cut, ensure_checkpoint_dir, spread
from ..operators.filters import And, Equals, In, Not, Or
from ..sources.tables import load
from ..store import MemoryStore

NOW_MS = 1_743_984_000_000  #: fixed clock of the queries
DIMS = 96
K = 10


# --- vectors --------------------------------------------------------------------------------------
def _vectors(spark: SparkSession, root: str) -> DataFrame:
    """``id, vec, metadata`` of the embeddings; metadata are the label and its parity, some rows have none."""
    e = load(spark, root, "embeddings")
    meta = F.when(
        F.col("vec_id") % 7 != 0,
        F.create_map(
            F.lit("label"), F.array(F.col("label").cast("string")), F.lit("parity"), F.array(F.when(F.col("label") % 2 == 0, "even").otherwise("odd"))
        ),
    )
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), meta.alias("metadata"))


def _query(spark: SparkSession, root: str) -> list[float]:
    return [float(x) for x in load(spark, root, "embeddings").where("vec_id = 1").first()["embedding"]]


def _edge(df: DataFrame) -> DataFrame:
    return df.withColumn("dist", F.round("dist", 6) + F.lit(0.0))


def _topk(metric: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        return _edge(knn.nearest(_vectors(spark, root), _query(spark, root), K, metric))

    return query


def _batch(metric: str):
    def query(spark: SparkSession, root: str) -> DataFrame:
        v = _vectors(spark, root)
        q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.lit(K).alias("k"))
        return _edge(knn.batch_nearest(q, v.select("id", "vec"), metric, most=K))

    return query


def _filtered(where):
    def query(spark: SparkSession, root: str) -> DataFrame:
        return _edge(knn.nearest(_vectors(spark, root), _query(spark, root), K, "l2", where.column(F.col("metadata"))))

    return query


FILTERS = {
    "eq": Equals("label", "3"),
    "in": In("label", ("1", "3", "5")),
    "and": And((Equals("parity", "odd"), In("label", ("3", "4", "5")))),
    "or": Or((Equals("label", "2"), Equals("parity", "odd"))),
    "not": Not(Equals("parity", "odd")),
    "empty_and": And(()),
}


def vec_distance_to(spark: SparkSession, root: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in _query(spark, root)])
    rows = _vectors(spark, root).where("id = 7")
    return rows.select("id", *[(F.round(distance(m, F.col("vec"), q), 6) + F.lit(0.0)).alias(m) for m in METRICS])


def _searched(vectors: DataFrame, all_vectors: DataFrame, metric: str, k: int = K) -> DataFrame:
    """Every row of ``all_vectors`` whose id is divisible by 100 as a query against ``vectors``."""
    q = all_vectors.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.lit(k).alias("k"))
    return knn.batch_nearest(q, vectors.select("id", "vec"), metric, most=k)


def _batch_filtered(where):
    def query(spark: SparkSession, root: str) -> DataFrame:
        v = _vectors(spark, root)
        return _edge(_searched(v.where(where.column(F.col("metadata"))), v, "l2"))

    return query


def vec_batch_distance_to(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root).select("id", "vec")
    q = v.where("id % 100 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    return q.crossJoin(v).select("qid", "id", *[(F.round(distance(m, F.col("vec"), F.col("q")), 6) + F.lit(0.0)).alias(m) for m in METRICS])


def vec_batch_union_delta_sealed(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    delta, sealed = v.where("id % 5 = 0"), v.where("id % 5 <> 0")
    return _edge(_searched(delta.unionByName(sealed), v, "dot"))


def vec_batch_anti_tombstone(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root).select("id", "vec")
    both = v.unionByName(v.select("id", F.transform("vec", lambda x: -x).alias("vec")))
    live = both.join(v.where("id % 3 = 0").select("id"), "id", "left_anti")
    # an id has two vectors, so the nearest 2 * K vectors hold the nearest K ids
    near = _searched(live, v, "cosine", 2 * K).groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    best = Window.partitionBy("qid").orderBy("dist", "id")
    return _edge(near.withColumn("rank", F.row_number().over(best)).where(f"rank <= {K}"))


def vec_batch_semi_filter(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    allowed = v.where("array_contains(metadata['parity'], 'even')").select("id")
    return _edge(_searched(v.join(allowed, "id", "left_semi"), v, "cosine"))


def vec_selectivity(spark: SparkSession, root: str) -> DataFrame:
    return filters.selectivity(_vectors(spark, root), FILTERS["and"]).withColumn("selectivity", F.round("selectivity", 9))


def vec_union_delta_sealed(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    delta, sealed = v.where("id % 5 = 0"), v.where("id % 5 <> 0")
    return _edge(knn.nearest(delta.unionByName(sealed), _query(spark, root), K, "dot"))


def vec_anti_tombstone(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    again = v.select("id", F.transform("vec", lambda x: -x).alias("vec"))
    both = v.select("id", "vec").unionByName(again)
    return _edge(knn.nearest_live(both, v.where("id % 3 = 0").select("id"), _query(spark, root), K, "cosine"))


def vec_semi_filter(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    allowed = v.where("array_contains(metadata['parity'], 'even')").select("id")
    return _edge(knn.nearest(v.join(allowed, "id", "left_semi"), _query(spark, root), K, "cosine"))


def vec_sizes(spark: SparkSession, root: str) -> DataFrame:
    v = _vectors(spark, root)
    return v.agg(F.count_if(F.col("id") % 5 == 0).alias("delta_rows"), F.count_if(F.col("id") % 5 != 0).alias("sealed_rows"), F.count("*").alias("total_rows"), (F.max("id") + 1).alias("next_id"))


def _partitioned(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, ivf.Codebook, DataFrame]:
    """The vectors, the same by cells, the codebook, and every row whose id is divisible by 100 as a query."""
    v = _vectors(spark, root)
    dims = spark.read.parquet(f"{root}/embeddings.parquet").select(F.max(F.size("embedding"))).first()[0] or 1
    indexed, book = ivf.build(v, dims, "l2", k=K)
    return v, indexed, book, v.where("id % 100 = 0").select(F.col("id").alias("qid"), "vec", F.lit(K).alias("k"))


def vec_recall_at_k(spark: SparkSession, root: str) -> DataFrame:
    """The partitioned index against exact search: its recall, and whether that is 0.9 at least."""
    v, indexed, book, q = _partitioned(spark, root)
    exact = knn.batch_nearest(q, v.select("id", "vec"), "l2", most=K)
    r = knn.recall_at_k(ivf.search(q, indexed, book), exact)
    return r.select("queries", "wanted", (F.col("recall") >= 0.9).alias("reached"))


def vec_approximate_filtered(spark: SparkSession, root: str) -> DataFrame:
    """Filtered search in the partitioned index: how many rows each query got, all of which must pass; a rare filter is searched to the end."""
    _, indexed, book, q = _partitioned(spark, root)
    passing = indexed.where(FILTERS["and"].column(F.col("metadata"))).select("id", "vec", "cell")
    found = ivf.search(q, passing, book).join(passing.select("id"), "id", "left_semi")
    return found.groupBy("qid").agg(F.count("*").alias("found"))


def _ids(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    v, has = _vectors(spark, root), lambda k, x: F.coalesce(F.array_contains(F.col("metadata")[k], x), F.lit(False))
    return v.where(has("parity", "odd")).select("id"), v.where(has("label", "3") | has("label", "4")).select("id")


def set_union_ids(spark: SparkSession, root: str) -> DataFrame:
    a, b = _ids(spark, root)
    return a.union(b).distinct()


def set_intersect_ids(spark: SparkSession, root: str) -> DataFrame:
    a, b = _ids(spark, root)
    return a.intersect(b)


def set_except_ids(spark: SparkSession, root: str) -> DataFrame:
    a, b = _ids(spark, root)
    return a.subtract(b)


# --- records ----------------------------------------------------------------------------------------
def _memories(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "memories")


def mem_current_view(spark: SparkSession, root: str) -> DataFrame:
    return records.latest(_memories(spark, root), ["tenant_id", "namespace", "kind", "importance", "status", "revision", "updated_at_ms"])


def scope_lookup(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["tenant_id", "namespace", "agent_id", "status"])
    return m.where(records.in_scope("tnt_arbor", "default")).select("id", "agent_id", "status")


def scope_agent_lookup(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["tenant_id", "namespace", "agent_id", "user_id"])
    return m.where(records.in_scope("tnt_arbor", "default", agent="agent_01")).select("id", "user_id")


def rebuild_active(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["status", "embedding", "embedding_dims"])
    return m.where("status = 'active' AND size(embedding) = embedding_dims").select("id", "embedding_dims")


def mem_not_expired(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["status", "expires_at_ms"])
    return m.where(records.live(NOW_MS)).select("id", "expires_at_ms")


def mem_purgeable(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["status", "expires_at_ms", "updated_at_ms"])
    return records.purgeable(m, NOW_MS).select("id", "status", "expires_at_ms")


def mem_vacuum_batch(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["status", "expires_at_ms", "updated_at_ms"])
    return records.vacuum_batch(m, NOW_MS, 100)


def mem_after_vacuum(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["status", "expires_at_ms", "updated_at_ms"])
    return records.vacuumed(m, NOW_MS, 100).select("id", "status")


def metadata_patch(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["metadata_json"])
    patch = F.create_map(F.lit("project"), F.lit("patched"), F.lit("reviewed"), F.lit("yes"))
    merged = S.patch_map(F.from_json("metadata_json", "map<string,string>"), patch)
    entries = F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return m.select("id", F.array_join(F.array_sort(entries), ";").alias("metadata"))


def token_estimates(spark: SparkSession, root: str) -> DataFrame:
    return records.latest(_memories(spark, root), ["content"]).select("id", S.token_estimate(F.col("content")).alias("tokens"))


def health_counts(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(_memories(spark, root), ["status", "embedding", "embedding_dims"])
    return records.health(m, load(spark, root, "operations"))


# --- operation log ----------------------------------------------------------------------------------
def _log(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "operations")


def ops_idempotent(spark: SparkSession, root: str) -> DataFrame:
    return oplog.operations_once(_log(spark, root))


def ops_pending(spark: SparkSession, root: str) -> DataFrame:
    return oplog.pending(_log(spark, root))


def update_conflicts(spark: SparkSession, root: str) -> DataFrame:
    return oplog.update_outcomes(_log(spark, root))


def recovery_replay(spark: SparkSession, root: str) -> DataFrame:
    return oplog.recovered(_log(spark, root), records.latest(_memories(spark, root), ["status"]))


def mem_tombstones(spark: SparkSession, root: str) -> DataFrame:
    return oplog.tombstones(_log(spark, root))


# --- store and index ----------------------------------------------------------------------------------
def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the session's shared one."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


def store_lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """Records remembered, updated, forgotten and vacuumed in a store, which is then opened again."""
    fields = ["tenant_id", "namespace", "content", "kind", "importance", "expires_at_ms", "status", "embedding"]
    m = cut(records.latest(_memories(spark, root), fields))
    path = _folder(spark, "store")
    store = MemoryStore.open(spark, path, DIMS, "test", clock=lambda: NOW_MS)
    store.remember_frame(m.withColumn("operation_id", F.col("id")))
    known = cut(store.log().select(F.col("operation_id").alias("id"), F.col("id").alias("stored")).join(m.select("id", "tenant_id", "namespace", "kind", "status"), "id"))
    facts = known.where("kind = 'fact'").select(F.col("stored").alias("id"), F.btrim("tenant_id").alias("tenant_id"), F.btrim("namespace").alias("namespace"), F.lit(1).alias("expected_revision"), F.lit(0.25).alias("importance"))
    store.update_frame(facts)
    store.forget_frame(known.where("status = 'deleted'").select(F.col("stored").alias("id"), "tenant_id", "namespace"))
    store.vacuum_tombstones(2**31 - 1)
    again = MemoryStore.open(spark, path, DIMS, "test", clock=lambda: NOW_MS)
    hashed = F.col("content_hash") == F.xxhash64("content")
    out = again.records().join(known.select(F.col("stored").alias("id"), F.col("id").alias("memory_id")), "id")
    return out.select("memory_id", "tenant_id", "namespace", "content", "kind", "importance", "status", "revision", hashed.alias("hashed"))


def index_reopened(spark: SparkSession, root: str) -> DataFrame:
    """Vectors put into an index in two parts, some removed, the index opened again and searched for every query row."""
    v = _vectors(spark, root)
    dims = spark.read.parquet(f"{root}/embeddings.parquet").select(F.max(F.size("embedding"))).first()[0] or 1
    path = _folder(spark, "index")
    ix = Index(spark, dims, "l2", path)
    ix.insert_frame(v.where("id % 2 = 0"))
    Index(spark, dims, "l2", path).insert_frame(v.where("id % 2 <> 0"))
    ix = Index(spark, dims, "l2", path)
    ix.remove(list(range(21)))
    ix.compact()
    return _edge(_searched(Index(spark, dims, "l2", path).frame(), v, "l2"))


def vec_filter_test(spark: SparkSession, root: str) -> DataFrame:
    """Whether single ids pass a filter given as a dictionary."""
    where = filters.from_dict({"parity": "odd", "label": ["3", "4", "5"]})
    return _vectors(spark, root).where("id % 100 = 0").select("id", where.column(F.col("metadata")).alias("passes"))


# --- full text and recall ---------------------------------------------------------------------------
def _docs(spark: SparkSession, root: str) -> DataFrame:
    m = records.latest(spread(_memories(spark, root)), ["tenant_id", "namespace", "content", "status"])
    return m.withColumn("live", F.col("status") == "active")


def _prepared(spark: SparkSession, root: str) -> DataFrame:
    return recall.prepared(spread(_memories(spark, root)))


def _requests(spark: SparkSession, root: str) -> DataFrame:
    return recall.valid_requests(load(spark, root, "recall_requests"), DIMS)


def fts_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    return fulltext.vocabulary(_docs(spark, root))


def fts_query_terms(spark: SparkSession, root: str) -> DataFrame:
    """What each request's text asks for: all of it as a phrase, then its terms."""
    return _requests(spark, root).where("text IS NOT NULL").select("qid", F.array_join(query_phrases(F.col("text")), "|").alias("phrases"))


def fts_search(spark: SparkSession, root: str) -> DataFrame:
    r = _requests(spark, root).select("qid", "tenant_id", "namespace", "text", "k")
    return fulltext.search(r, cut(_docs(spark, root))).drop("dist").withColumn("bm25", F.round("bm25", 6))


def recall_invalid(spark: SparkSession, root: str) -> DataFrame:
    return recall.invalid_requests(load(spark, root, "recall_requests"), DIMS)


def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    return recall.candidates(_requests(spark, root), _prepared(spark, root)).select("qid", "id", "vrank", "trank", F.round("rrf", 9).alias("rrf"))


def _scores(spark: SparkSession, root: str, **agent: bool) -> DataFrame:
    r, m = _requests(spark, root), _prepared(spark, root)
    return recall.scored(r, m, recall.candidates(r, m), **agent)


def recall_scored(spark: SparkSession, root: str) -> DataFrame:
    return recall.top(_scores(spark, root)).select("qid", "id", F.round("score", 6).alias("score"), "position")


def recall_explained(spark: SparkSession, root: str) -> DataFrame:
    s = _scores(spark, root)
    parts = [F.round(c, 6).alias(c) for c in ("score", "similarity", "importance_score", "recency", "reinforcement")]
    return s.select("qid", "id", *parts, F.array_join("notes", ",").alias("notes"))


def recall_agent_scope(spark: SparkSession, root: str) -> DataFrame:
    return _scores(spark, root, by_agent=True, by_user=True).select("qid", "id", F.round("score", 6).alias("score"))


def recall_mmr(spark: SparkSession, root: str) -> DataFrame:
    r, m = _requests(spark, root), _prepared(spark, root)
    return recall.diversified(recall.scored(r, m, recall.candidates(r, m)), m).select("qid", "id", F.round("score", 6).alias("score"), F.round("mmr", 6).alias("mmr"), "position")


def recall_full(spark: SparkSession, root: str) -> DataFrame:
    out = recall.recall(load(spark, root, "recall_requests"), spread(_memories(spark, root)), DIMS)
    return out.select("qid", "id", "kind", F.round("score", 6).alias("score"), "position", "returned")


def _recalled(spark: SparkSession, root: str) -> DataFrame:
    r, m = _requests(spark, root), _prepared(spark, root)
    best = recall.top(recall.scored(r, m, recall.candidates(r, m))).select("qid", "id", "position", "kind", "score")
    return best.join(m.select("id", "content"), "id").select("qid", "position", "kind", "content", "score")


def context_lines(spark: SparkSession, root: str) -> DataFrame:
    return context.lines(_recalled(spark, root), max_tokens=300).select("qid", "position", "line", "tokens", "used")


def context_texts(spark: SparkSession, root: str) -> DataFrame:
    return context.contexts(_recalled(spark, root), max_tokens=300, footer="---").select("qid", "tokens", "context")


QUERIES = {
    "vec_l2_topk": _topk("l2"),
    "vec_cosine_topk": _topk("cosine"),
    "vec_dot_topk": _topk("dot"),
    "vec_batch_knn": _batch("cosine"),
    "vec_batch_knn_l2": _batch("l2"),
    "vec_batch_knn_dot": _batch("dot"),
    **{f"vec_filter_{n}": _filtered(f) for n, f in FILTERS.items()},
    **{f"vec_batch_filter_{n}": _batch_filtered(f) for n, f in FILTERS.items()},
    **{
        f.__name__: f
        for f in (
            vec_batch_distance_to, vec_batch_union_delta_sealed, vec_batch_anti_tombstone, vec_batch_semi_filter,
            vec_distance_to, vec_selectivity, vec_union_delta_sealed, vec_anti_tombstone, vec_semi_filter, vec_sizes, vec_recall_at_k, vec_approximate_filtered,
            set_union_ids, set_intersect_ids, set_except_ids,
            mem_current_view, scope_lookup, scope_agent_lookup, rebuild_active, mem_not_expired, mem_purgeable, mem_vacuum_batch, mem_after_vacuum,
            metadata_patch, token_estimates, health_counts,
            ops_idempotent, ops_pending, update_conflicts, recovery_replay, mem_tombstones,
            store_lifecycle, index_reopened, vec_filter_test, fts_query_terms,
            fts_vocabulary, fts_search, recall_invalid, rrf_fusion, recall_scored, recall_explained, recall_agent_scope, recall_mmr, recall_full,
            context_lines, context_texts,
        )
    },
}
