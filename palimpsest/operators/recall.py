"""Hybrid recall: dense and text candidates, reciprocal rank fusion, explained scores, diversity.

A batch of requests is one plan: two candidate branches, each cut to three times the request's
limit within its scope, fused on (request, id), filtered, scored and ranked. Diversification runs
on each request's candidates, of which there are at most six times its limit.

Differences kept from the start: the scope is applied before the candidates are cut; agent and
user narrow a scope only on demand. Defined results: requests without id, tenant, namespace or a
positive limit, with a vector that isn't usable, or with a lambda outside 0 to 1, are invalid and
give no rows (``invalid_requests`` names them); a blank text searches by vector alone; a record
without a usable vector can still be found by text, its similarity is that of distance 1; a null
importance scores 0 and fails any minimum; metadata must equal in every key asked for, type
included, and metadata that isn't a JSON object fails; equal scores are ordered by fused rank,
then id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import fulltext, knn
from .durable import cut
from .records import latest, live

MAX_RECALL_LIMIT = 100
_SCORED = ["qid", "id", "score", "rrf", "top", "mmr_lambda"]
_FIELDS = ["tenant_id", "namespace", "agent_id", "user_id", "kind", "content", "embedding", "embedding_dims", "importance", "created_at_ms", "access_count", "expires_at_ms", "status", "metadata_json"]


def _reason(dims: int | None):
    bad_vector = "query_embedding IS NULL OR size(query_embedding) = 0 OR exists(query_embedding, e -> e IS NULL OR isnan(e))"
    if dims:
        bad_vector += f" OR size(query_embedding) <> {dims}"
    return F.expr(
        f"""CASE WHEN request_id IS NULL THEN 'request_id' WHEN coalesce(btrim(tenant_id), '') = '' THEN 'tenant_id'
        WHEN coalesce(btrim(namespace), '') = '' THEN 'namespace' WHEN coalesce(max_items, 0) <= 0 THEN 'max_items'
        WHEN {bad_vector} THEN 'query_embedding' WHEN mmr_lambda < 0 OR mmr_lambda > 1 OR isnan(mmr_lambda) THEN 'mmr_lambda' END"""
    )


def invalid_requests(requests: DataFrame, dims: int | None = None) -> DataFrame:
    """``request_id, reason``: the first rule each invalid request breaks."""
    return requests.select("request_id", _reason(dims).alias("reason")).where("reason IS NOT NULL")


def valid_requests(requests: DataFrame, dims: int | None = None, most: int = MAX_RECALL_LIMIT) -> DataFrame:
    ok = requests.where(_reason(dims).isNull())
    return ok.select(
        F.col("request_id").alias("qid"),
        F.btrim("tenant_id").alias("tenant_id"),
        F.btrim("namespace").alias("namespace"),
        F.col("agent_id").alias("q_agent"),
        F.col("user_id").alias("q_user"),
        F.col("query_embedding").alias("vec"),
        F.col("query_text").alias("text"),
        F.col("max_items").cast("int").alias("top"),
        (F.least(F.col("max_items"), F.lit(most)) * 3).cast("int").alias("k"),
        F.col("kinds").alias("q_kinds"),
        F.col("min_importance").alias("q_min"),
        S.json_entries("metadata_eq_json").alias("q_meta"),
        F.col("metadata_eq_json").isNotNull().alias("q_has_meta"),
        "mmr_lambda",
        F.col("asked_at_ms").alias("now_ms"),
    )


def prepared(memories: DataFrame) -> DataFrame:
    """The latest states with what recall reads of them, written once: three branches of the plan read them."""
    return cut(latest(memories, _FIELDS))


def _has_metadata():
    """Whether ``meta`` has all that ``q_meta`` asks for, where ``q_has_meta``."""
    asks = F.coalesce(F.size("q_meta") > 0, F.lit(False))
    return ~F.col("q_has_meta") | (F.col("q_meta").isNotNull() & (~asks | (F.coalesce(F.size(F.array_except("q_meta", "meta")), F.lit(1)) == 0)))


def candidates(requests: DataFrame, records: DataFrame, most: int = MAX_RECALL_LIMIT) -> DataFrame:
    """``qid, id, vrank, dist, trank, rrf``: both candidate lists of the valid requests over ``prepared`` records, fused."""
    active = records.where("status = 'active'")
    vectors = active.where("size(embedding) = embedding_dims").select("id", "tenant_id", "namespace", F.col("embedding").alias("vec"))
    dense = knn.batch_nearest(requests.select("qid", "vec", "k", "tenant_id", "namespace"), vectors, "cosine", ["tenant_id", "namespace"], most=3 * most)
    docs = records.select("id", "tenant_id", "namespace", "content", (F.col("status") == "active").alias("live"), S.json_entries("metadata_json").alias("entries"), F.when(F.size("embedding") == F.col("embedding_dims"), F.col("embedding")).alias("vec"))
    # metadata is asked for before the cut; kinds, importance and expiry come after it, as does everything in the dense branch
    asking = requests.where("NOT q_has_meta OR q_meta IS NOT NULL").select("qid", "tenant_id", "namespace", "text", "k", "vec", F.col("q_meta").alias("asked"))
    text = fulltext.search(asking, docs, 3 * most)
    both = fuse(dense.select("qid", "id", F.col("rank").alias("vrank"), "dist"), text.select("qid", "id", F.col("rank").alias("trank"), F.col("dist").alias("text_dist")))
    return both.withColumn("dist", F.coalesce("dist", "text_dist")).drop("text_dist")


def fuse(dense: DataFrame, text: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (qid, id, vrank) and (qid, id, trank): each list gives 1 / (60 + rank); other columns stay."""
    both = dense.join(text, ["qid", "id"], "full_outer")
    part = [F.coalesce(1.0 / (S.RRF_K + F.col(c)), F.lit(0.0)) for c in ("vrank", "trank")]
    return both.withColumn("rrf", part[0] + part[1])


def scored(requests: DataFrame, records: DataFrame, pool: DataFrame, by_agent: bool = False, by_user: bool = False) -> DataFrame:
    """The candidates that pass their request's filters, with all score components and notes; texts and vectors stay behind."""
    c = pool.join(requests.drop("tenant_id", "namespace", "vec", "text", "k"), "qid").join(records.drop("tenant_id", "namespace", "content", "embedding", "embedding_dims"), "id")
    c = c.where(live(F.col("now_ms")))
    c = c.where(F.col("q_kinds").isNull() | F.array_contains("q_kinds", F.col("kind")))
    c = c.where(F.col("q_min").isNull() | (F.col("importance") >= F.col("q_min")))
    c = c.withColumn("meta", S.json_entries("metadata_json")).where(_has_metadata())
    if by_agent:
        c = c.where(F.col("q_agent").isNull() | (F.col("agent_id") == F.col("q_agent")))
    if by_user:
        c = c.where(F.col("q_user").isNull() | (F.col("user_id") == F.col("q_user")))
    importance = F.coalesce(S.clamp01(F.nanvl(F.col("importance"), F.lit(0.0))), F.lit(0.0))
    c = c.withColumn("similarity", S.similarity(F.col("dist"))).withColumn("importance_score", importance)
    c = c.withColumn("recency", S.recency(F.col("created_at_ms"), F.col("now_ms"))).withColumn("reinforcement", S.reinforcement(F.col("access_count")))
    c = c.withColumn("score", F.round(S.total_score(F.col("similarity"), F.col("importance_score"), F.col("recency"), F.col("reinforcement")), 9))
    # fixed values: the names of the notes
    notes = F.array_compact(
        F.array(
            F.lit("default_v1_scoring"),
            F.when(F.col("trank").isNotNull(), "fts5_lexical_candidate"),
            F.when(F.col("trank").isNotNull() & F.col("vrank").isNotNull(), "reciprocal_rank_fusion"),
        )
    )
    return c.withColumn("notes", notes)


def top(scores: DataFrame, most: int = MAX_RECALL_LIMIT) -> DataFrame:
    """Each request's best by score, with ``position``; the literal bound lets Spark cut before the shuffle."""
    best = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("rrf").desc(), "id")
    return scores.withColumn("position", F.row_number().over(best)).where(f"position <= {2 * 3 * most}").where("position <= top")


def _diversify(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["rrf", "id"], ascending=[False, True]).reset_index(drop=True)
    lam, limit, n = float(pdf["mmr_lambda"].iloc[0]), int(pdf["top"].iloc[0]), len(pdf)
    score = pdf["score"].to_numpy(float)
    unit = [np.asarray(v, float) if v is not None else np.zeros(0) for v in pdf["embedding"]]
    worst = np.zeros(n)
    open_, order = np.ones(n, bool), []
    while len(order) < min(limit, n):
        value = np.where(open_, np.round(lam * score - (1 - lam) * worst, 9), -np.inf)
        i = int(np.argmax(value))
        order.append((i, value[i]))
        open_[i] = False
        for j in np.flatnonzero(open_):
            a, b = unit[i], unit[j]
            m = min(len(a), len(b))
            a, b = a[:m], b[:m]
            norms = max(float(np.sqrt(a @ a) * np.sqrt(b @ b)), 1.1920928955078125e-07)
            worst[j] = max(worst[j], min(1.0, max(0.0, float(a @ b) / norms)))
    at = [i for i, _ in order]
    return pd.DataFrame({"qid": pdf["qid"].iloc[at].to_numpy(), "id": pdf["id"].iloc[at].to_numpy(), "score": score[at], "mmr": [v for _, v in order], "position": np.arange(1, len(at) + 1)})


def diversified(scores: DataFrame, records: DataFrame) -> DataFrame:
    """``qid, id, score, mmr, position``: maximal marginal relevance of the requests that have a lambda.

    Greedy: lambda times score less (1 - lambda) times the greatest similarity (at least 0) to what
    was taken, an unusable vector being like none; of equal values the earlier in fused order wins. A group has at most six times the greatest limit of rows.
    """
    usable = (F.size("embedding") == F.col("embedding_dims")) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = records.select("id", F.when(usable, F.col("embedding")).alias("embedding"))
    rows = scores.where("mmr_lambda IS NOT NULL").select("qid", "id", "score", "rrf", "top", "mmr_lambda").join(vectors, "id")
    return rows.groupBy("qid").applyInPandas(_diversify, "qid string, id string, score double, mmr double, position int")


def recall(requests: DataFrame, memories: DataFrame, dims: int | None = None, most: int = MAX_RECALL_LIMIT) -> DataFrame:
    """``qid, id, content, kind, score, position, returned``: requests with a lambda diversified, the others by score."""
    valid, records = valid_requests(requests, dims, most), prepared(memories)
    scores = cut(scored(valid, records, candidates(valid, records, most)).select(*_SCORED))
    plain = top(scores.where("mmr_lambda IS NULL"), most).select("qid", "id", "score", "position")
    both = plain.unionByName(diversified(scores, records).select("qid", "id", "score", "position"))
    texts = records.select("id", "kind", "content")
    whole = Window.partitionBy("qid")  # at most a request's limit of rows
    return both.join(texts, "id").withColumn("returned", F.count("*").over(whole)).select("qid", "id", "content", "kind", "score", "position", "returned")
