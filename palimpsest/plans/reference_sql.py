"""Oracle SQL (DuckDB) of the engine's own queries, written independently of the operators."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN

_V = """
v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label::VARCHAR AS label,
         CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, vec_id % 7 <> 0 AS has FROM embeddings),
q AS (SELECT vec AS qv FROM v WHERE id = 1)
"""
_EPS = "1.1920928955078125e-07"


def _cos(a: str, b: str) -> str:
    return f"(1 - list_inner_product({a}, {b}) / greatest(sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})), {_EPS}))"


def _metric(m: str, a: str, b: str) -> str:
    return {"l2": f"list_distance({a}, {b}) ** 2", "cosine": _cos(a, b), "dot": f"-list_inner_product({a}, {b})"}[m]


def _topk(m: str, where: str = "true", source: str = "v") -> str:
    return f"""
WITH {_V}, d AS (SELECT id, round({_metric(m, 'vec', 'qv')}, 9) AS dist FROM {source}, q WHERE {where})
SELECT id, round(dist, 6) + 0.0 AS dist FROM d ORDER BY d.dist, id LIMIT 10"""


def _batch(m: str) -> str:
    return f"""
WITH {_V}, d AS (
  SELECT a.id AS qid, v.id, round({_metric(m, 'v.vec', 'a.vec')}, 9) AS dist FROM v a, v WHERE a.id % 100 = 0)
SELECT qid, id, round(dist, 6) + 0.0 AS dist, (row_number() OVER (PARTITION BY qid ORDER BY d.dist, id))::INT AS rank FROM d
QUALIFY rank <= 10"""


def _batch_of(m: str, where: str = "true", source: str = "v") -> str:
    return f"""
WITH {_V}, d AS (
  SELECT a.id AS qid, v.id, min(round({_metric(m, 'v.vec', 'a.vec')}, 9)) AS dist FROM v a, (SELECT * FROM {source} WHERE {where}) v WHERE a.id % 100 = 0 GROUP BY a.id, v.id)
SELECT qid, id, round(dist, 6) + 0.0 AS dist, (row_number() OVER (PARTITION BY qid ORDER BY d.dist, id))::INT AS rank FROM d
QUALIFY rank <= 10"""


_STATUS = "CASE WHEN lower(trim(status)) IN ('pending', 'active', 'deleted', 'expired') THEN lower(trim(status)) ELSE 'pending' END"
_KIND = "CASE WHEN lower(trim(kind)) IN ('episodic', 'fact', 'preference', 'instruction', 'context') THEN lower(trim(kind)) ELSE 'episodic' END"
_M = f"""
m AS (
  SELECT * REPLACE ({_STATUS} AS status, {_KIND} AS kind) FROM (
    SELECT * FROM memories WHERE id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY coalesce(revision, -1) DESC, coalesce(updated_at_ms, -1) DESC, coalesce(access_count, -1) DESC,
      coalesce(last_accessed_at_ms, -1) DESC, coalesce(importance, -1) DESC, coalesce(expires_at_ms, -1) DESC, coalesce(status, '') DESC, coalesce(metadata_json, '') DESC) = 1))
"""
_NOW = 1743984000000
_REASON = """
CASE WHEN request_id IS NULL THEN 'request_id' WHEN coalesce(trim(tenant_id), '') = '' THEN 'tenant_id' WHEN coalesce(trim(namespace), '') = '' THEN 'namespace'
     WHEN coalesce(max_items, 0) <= 0 THEN 'max_items' WHEN query_embedding IS NULL OR len(query_embedding) <> 96 THEN 'query_embedding'
     WHEN mmr_lambda < 0 OR mmr_lambda > 1 OR isnan(mmr_lambda) THEN 'mmr_lambda' END
"""
_FOLD = "translate(regexp_replace(lower({}), '[\\x{{0300}}-\\x{{036f}}]', '', 'g'), '%s', '%s')" % (ACCENTED, PLAIN)
_TOKENS = f"regexp_extract_all({_FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
_USABLE = "embedding IS NOT NULL AND len(embedding) = embedding_dims AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_FTS = f"""
t AS (SELECT id, tenant_id, namespace, status = 'active' AS live, {_TOKENS.format('content')} AS terms FROM m WHERE content IS NOT NULL),
st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM t),
p AS (SELECT id, tenant_id, namespace, live, len(terms) AS dl, unnest(terms) AS term FROM t),
tf AS (SELECT id, tenant_id, namespace, live, dl, term, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term)
"""
_R = f"""
r AS (
  SELECT request_id AS qid, trim(tenant_id) AS tenant_id, trim(namespace) AS namespace, agent_id AS q_agent, user_id AS q_user,
         list_transform(query_embedding, lambda x: x::DOUBLE) AS vec, query_text AS text, max_items AS top, least(max_items, 100) * 3 AS k, kinds AS q_kinds,
         min_importance AS q_min, metadata_eq_json AS q_meta, mmr_lambda, asked_at_ms AS now_ms
  FROM recall_requests WHERE ({_REASON}) IS NULL)
"""
_ENTRIES = "CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN list_transform(json_keys({0}), lambda k: k || chr(31) || json_extract({0}, '$.\"' || k || '\"')::VARCHAR) END"
_SEARCH = f"""
q0 AS (SELECT qid, tenant_id, namespace, k, q_meta, {_FOLD.format("regexp_replace(text, '[^\\p{L}\\p{N}_-]', ' ', 'g')")} AS clean FROM r WHERE text IS NOT NULL),
q1 AS (SELECT *, list_filter(list_transform(string_split_regex(clean, '\\s+'), lambda t: array_to_string(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]+'), ' ')), lambda t: t <> '') AS terms,
       array_to_string(regexp_extract_all(clean, '[\\p{{L}}\\p{{N}}]+'), ' ') AS whole FROM q0),
qw AS (SELECT qid, tenant_id, namespace, k, q_meta, term, count(*) AS w FROM (SELECT qid, tenant_id, namespace, k, q_meta, unnest(list_concat([whole], terms)) AS term FROM q1 WHERE len(terms) > 0) GROUP BY ALL),
ph AS (SELECT DISTINCT term, string_split(term, ' ') AS ts FROM qw WHERE contains(term, ' ')),
pt AS (
  SELECT tf.id, tf.tenant_id, tf.namespace, tf.live, tf.dl, ph.term,
         len(list_filter(range(1, tf.dl - len(ph.ts) + 2), lambda i: t.terms[i:i + len(ph.ts) - 1] = ph.ts)) AS tf
  FROM ph JOIN tf ON tf.term = ph.ts[1] JOIN t ON t.id = tf.id),
every AS (SELECT id, tenant_id, namespace, live, dl, term, tf FROM tf UNION ALL SELECT * FROM pt WHERE tf > 0),
dfs AS (SELECT term, count(*) AS df FROM every GROUP BY term),
meta AS (SELECT id, {_ENTRIES.format('metadata_json')} AS entries FROM m),
hits AS (
  SELECT qw.qid, p.id, any_value(qw.k) AS k, any_value(qw.q_meta) AS q_meta,
    round(sum(w * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS bm25
  FROM qw JOIN dfs USING (term) JOIN every p ON p.term = qw.term AND p.tenant_id = qw.tenant_id AND p.namespace = qw.namespace, st
  WHERE p.live GROUP BY qw.qid, p.id),
fit AS (SELECT hits.* FROM hits JOIN meta USING (id) WHERE {{asked}}),
txt AS (SELECT qid, id, bm25, (row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id))::INT AS trank FROM fit QUALIFY trank <= k)
"""
_ASKED = f"q_meta IS NULL OR (json_valid(q_meta) AND json_type(q_meta) = 'OBJECT' AND len(list_filter({_ENTRIES.format('q_meta')}, lambda e: NOT list_contains(coalesce(entries, []), e))) = 0)"
_POOL = f"""
e AS (SELECT id, tenant_id, namespace, list_transform(embedding, lambda x: x::DOUBLE) AS emb FROM m WHERE status = 'active' AND {_USABLE}),
dn AS (
  SELECT r.qid, e.id, r.k, round({_cos('e.emb', 'r.vec')}, 9) AS dist FROM r JOIN e ON r.tenant_id = e.tenant_id AND r.namespace = e.namespace AND len(e.emb) = len(r.vec)),
dense AS (SELECT qid, id, (row_number() OVER (PARTITION BY qid ORDER BY dist, id))::INT AS vrank FROM dn QUALIFY vrank <= k),
pool AS (
  SELECT coalesce(dense.qid, txt.qid) AS qid, coalesce(dense.id, txt.id) AS id, vrank, trank,
         coalesce(1.0::DOUBLE / (60 + vrank), 0) + coalesce(1.0::DOUBLE / (60 + trank), 0) AS rrf
  FROM dense FULL JOIN txt ON dense.qid = txt.qid AND dense.id = txt.id)
"""
_CLEAN = f"len(m.embedding) = m.embedding_dims AND len(m.embedding) = len(r.vec) AND len(list_filter(m.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SCORES = f"""
c AS (
  SELECT p.qid, p.id, p.vrank, p.trank, p.rrf, r.top, r.q_agent, r.q_user, r.mmr_lambda, m.agent_id, m.user_id, m.kind, m.content,
    CASE WHEN {_CLEAN} THEN round({_cos('list_transform(m.embedding, lambda x: x::DOUBLE)', 'r.vec')}, 9) ELSE 1.0 END AS cosd,
    CASE WHEN m.importance IS NULL OR isnan(m.importance) THEN 0 ELSE least(1.0, greatest(0.0, m.importance)) END AS importance_score,
    coalesce(exp(-greatest(r.now_ms - m.created_at_ms, 0) / 604800000.0), 0) AS recency,
    least(1.0, greatest(0.0, coalesce(m.access_count, 0) / 10.0)) AS reinforcement
  FROM pool p JOIN r USING (qid) JOIN m USING (id)
  WHERE m.status = 'active' AND (m.expires_at_ms IS NULL OR m.expires_at_ms > r.now_ms)
    AND (r.q_kinds IS NULL OR list_contains(r.q_kinds, m.kind))
    AND (r.q_min IS NULL OR m.importance >= r.q_min)
    AND (r.q_meta IS NULL OR (json_valid(r.q_meta) AND json_type(r.q_meta) = 'OBJECT' AND (len(json_keys(r.q_meta)) = 0 OR (m.metadata_json IS NOT NULL AND json_valid(m.metadata_json)
         AND len(list_filter(json_keys(r.q_meta), lambda k: coalesce(json_extract(m.metadata_json, '$."' || k || '"')::VARCHAR <> json_extract(r.q_meta, '$."' || k || '"')::VARCHAR, true))) = 0))))),
s AS (
  SELECT *, least(1.0, greatest(0.0, 1 - cosd / 2)) AS similarity,
         round(0.70 * least(1.0, greatest(0.0, 1 - cosd / 2)) + 0.15 * importance_score + 0.10 * recency + 0.05 * reinforcement, 9) AS score FROM c)
"""
_RECALL = f"WITH {_M}, {_R}, {_FTS}, {_SEARCH.replace("{asked}", _ASKED)}, {_POOL}, {_SCORES}"
_TOP = "SELECT *, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, rrf DESC, id))::INT AS position FROM s QUALIFY position <= top"
_DIVERSE = f"""
{_RECALL[len('WITH '):]},
e0 AS (SELECT s.qid, s.id, s.score, s.rrf, s.top, s.mmr_lambda AS lam, CASE WHEN len(m.embedding) = m.embedding_dims AND len(list_filter(m.embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 THEN list_transform(m.embedding, lambda x: x::DOUBLE) END AS v
       FROM s JOIN m USING (id) WHERE s.mmr_lambda IS NOT NULL),
couples AS (
  SELECT a.qid, a.id AS a, b.id AS b, a.v[1:least(len(a.v), len(b.v))] AS x, b.v[1:least(len(a.v), len(b.v))] AS y FROM e0 a JOIN e0 b ON a.qid = b.qid AND a.id <> b.id),
alike AS (
  SELECT qid, a, b, least(1.0, greatest(0.0, list_inner_product(x, y) / greatest(sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)), {_EPS}))) AS sim FROM couples),
z AS (
  SELECT 0 AS step, qid, id, score, rrf, top, lam, 0.0::DOUBLE AS worst, false AS chosen, NULL::DOUBLE AS mmr FROM e0
  UNION ALL
  SELECT x.step + 1, x.qid, x.id, x.score, x.rrf, x.top, x.lam, greatest(x.worst, coalesce(sim, 0.0)), x.id = x.pick, x.value
  FROM (SELECT *, round(lam * score - (1 - lam) * worst, 9) AS value,
               first_value(id) OVER (PARTITION BY qid ORDER BY round(lam * score - (1 - lam) * worst, 9) DESC, rrf DESC, id) AS pick
        FROM z WHERE NOT chosen AND step < top) x
  LEFT JOIN alike ON alike.qid = x.qid AND alike.a = x.pick AND alike.b = x.id)
"""
_LINE = "'- [' || kind || '] ' || coalesce(content, '') || ' (score: ' || printf('%.2f', score) || ')'"

_O = r"""
o AS (
  SELECT operation_id, max(memory_id) AS memory_id, max(lower(trim(kind))) AS kind,
         CASE WHEN coalesce(bool_or(lower(trim(state)) = 'applied'), false) THEN 'applied' ELSE 'pending' END AS state,
         min(created_at_ms) AS created_at_ms, max(TRY_CAST(nullif(regexp_extract(payload_json, '"revision"\s*:\s*"?(\d+)"?\s*[,}]', 1), '') AS BIGINT)) AS revision, count(*) AS deliveries
  FROM operations WHERE operation_id IS NOT NULL GROUP BY operation_id),
k AS (
  SELECT *, coalesce(created_at_ms, -9223372036854775807) AS at_ms, coalesce(revision, -9223372036854775807) AS rev
  FROM o WHERE trim(coalesce(memory_id, '')) <> '')
"""

SQL: dict[str, str] = {
    "vec_l2_topk": _topk("l2"),
    "vec_cosine_topk": _topk("cosine"),
    "vec_dot_topk": _topk("dot"),
    "vec_batch_knn": _batch("cosine"),
    "vec_batch_knn_l2": _batch("l2"),
    "vec_batch_knn_dot": _batch("dot"),
    "vec_filter_eq": _topk("l2", "has AND label = '3'"),
    "vec_filter_in": _topk("l2", "has AND label IN ('1', '3', '5')"),
    "vec_filter_and": _topk("l2", "has AND parity = 'odd' AND label IN ('3', '4', '5')"),
    "vec_filter_or": _topk("l2", "has AND (label = '2' OR parity = 'odd')"),
    "vec_filter_not": _topk("l2", "has AND NOT parity = 'odd'"),
    "vec_filter_empty_and": _topk("l2", "false"),
    "vec_batch_filter_eq": _batch_of("l2", "has AND label = '3'"),
    "vec_batch_filter_in": _batch_of("l2", "has AND label IN ('1', '3', '5')"),
    "vec_batch_filter_and": _batch_of("l2", "has AND parity = 'odd' AND label IN ('3', '4', '5')"),
    "vec_batch_filter_or": _batch_of("l2", "has AND (label = '2' OR parity = 'odd')"),
    "vec_batch_filter_not": _batch_of("l2", "has AND NOT parity = 'odd'"),
    "vec_batch_filter_empty_and": _batch_of("l2", "false"),
    "vec_batch_union_delta_sealed": _batch_of("dot", source="(SELECT * FROM v WHERE id % 5 = 0 UNION ALL SELECT * FROM v WHERE id % 5 <> 0)"),
    "vec_batch_anti_tombstone": _batch_of("cosine", "id % 3 <> 0", "(SELECT id, vec FROM v UNION ALL SELECT id, list_transform(vec, lambda x: -x) FROM v)"),
    "vec_batch_semi_filter": _batch_of("cosine", "has AND parity = 'even'"),
    "vec_batch_distance_to": f"""
WITH {_V} SELECT a.id AS qid, v.id, round({_metric('l2', 'v.vec', 'a.vec')}, 6) + 0.0 AS l2, round({_metric('cosine', 'v.vec', 'a.vec')}, 6) + 0.0 AS cosine,
  round({_metric('dot', 'v.vec', 'a.vec')}, 6) + 0.0 AS dot FROM v a, v WHERE a.id % 100 = 0""",
    "vec_distance_to": f"""
WITH {_V} SELECT id, round({_metric('l2', 'vec', 'qv')}, 6) + 0.0 AS l2, round({_metric('cosine', 'vec', 'qv')}, 6) + 0.0 AS cosine, round({_metric('dot', 'vec', 'qv')}, 6) + 0.0 AS dot
FROM v, q WHERE id = 7""",
    "vec_selectivity": f"""
WITH {_V}, x AS (SELECT count(*) FILTER (WHERE has AND parity = 'odd' AND label IN ('3', '4', '5')) AS matched, count(*) FILTER (WHERE has) AS total FROM v)
SELECT matched, total, round(CASE WHEN total = 0 THEN 1.0 ELSE matched / total END, 9) AS selectivity FROM x""",
    "vec_union_delta_sealed": _topk("dot", source="(SELECT * FROM v WHERE id % 5 = 0 UNION ALL SELECT * FROM v WHERE id % 5 <> 0)"),
    "vec_anti_tombstone": f"""
WITH {_V}, b AS (SELECT id, vec FROM v UNION ALL SELECT id, list_transform(vec, lambda x: -x) FROM v),
d AS (SELECT id, min(round({_cos('vec', 'qv')}, 9)) AS dist FROM b, q WHERE id NOT IN (SELECT id FROM v WHERE id % 3 = 0) GROUP BY id)
SELECT id, round(dist, 6) + 0.0 AS dist FROM d ORDER BY d.dist, id LIMIT 10""",
    "vec_semi_filter": _topk("cosine", "id IN (SELECT id FROM v WHERE has AND parity = 'even')"),
    "vec_sizes": f"""
WITH {_V} SELECT count(*) FILTER (WHERE id % 5 = 0) AS delta_rows, count(*) FILTER (WHERE id % 5 <> 0) AS sealed_rows, count(*) AS total_rows, max(id) + 1 AS next_id FROM v""",
    "vec_recall_at_k": f"""
WITH {_V} SELECT count(*) AS queries, count(*) * 10 AS wanted, true AS reached FROM v WHERE id % 100 = 0""",
    "vec_approximate_filtered": f"""
WITH {_V}, p AS (SELECT count(*) AS n FROM v WHERE has AND parity = 'odd' AND label IN ('3', '4', '5'))
SELECT id AS qid, least(10, n) AS found FROM v, p WHERE id % 100 = 0 AND n > 0""",
    "set_union_ids": f"WITH {_V} SELECT id FROM v WHERE has AND parity = 'odd' UNION SELECT id FROM v WHERE has AND label IN ('3', '4')",
    "set_intersect_ids": f"WITH {_V} SELECT id FROM v WHERE has AND parity = 'odd' INTERSECT SELECT id FROM v WHERE has AND label IN ('3', '4')",
    "set_except_ids": f"WITH {_V} SELECT id FROM v WHERE has AND parity = 'odd' EXCEPT SELECT id FROM v WHERE has AND label IN ('3', '4')",
    "mem_current_view": f"WITH {_M} SELECT id, tenant_id, namespace, kind, importance, status, revision, updated_at_ms FROM m",
    "scope_lookup": f"WITH {_M} SELECT id, agent_id, status FROM m WHERE tenant_id = 'tnt_arbor' AND namespace = 'default'",
    "scope_agent_lookup": f"WITH {_M} SELECT id, user_id FROM m WHERE tenant_id = 'tnt_arbor' AND namespace = 'default' AND agent_id = 'agent_01'",
    "rebuild_active": f"WITH {_M} SELECT id, embedding_dims FROM m WHERE status = 'active' AND len(embedding) = embedding_dims",
    "mem_not_expired": f"WITH {_M} SELECT id, expires_at_ms FROM m WHERE status = 'active' AND (expires_at_ms IS NULL OR expires_at_ms > {_NOW})",
    "mem_purgeable": f"WITH {_M} SELECT id, status, expires_at_ms FROM m WHERE status = 'deleted' OR expires_at_ms <= {_NOW}",
    "mem_vacuum_batch": f"WITH {_M} SELECT id, updated_at_ms FROM m WHERE status = 'deleted' OR expires_at_ms <= {_NOW} ORDER BY updated_at_ms NULLS FIRST, id LIMIT 100",
    "mem_after_vacuum": f"""
WITH {_M}, g AS (SELECT id FROM m WHERE status = 'deleted' OR expires_at_ms <= {_NOW} ORDER BY updated_at_ms NULLS FIRST, id LIMIT 100)
SELECT id, status FROM m WHERE id NOT IN (SELECT id FROM g)""",
    "metadata_patch": f"""
WITH {_M}, j AS (SELECT id, CASE WHEN json_valid(metadata_json) AND json_type(metadata_json) = 'OBJECT' THEN metadata_json ELSE '{{}}' END AS doc FROM m)
SELECT id, array_to_string(list_sort(list_concat(['project=patched', 'reviewed=yes'],
  list_transform(list_filter(json_keys(doc), lambda k: k NOT IN ('project', 'reviewed')), lambda k: k || '=' || coalesce(json_extract_string(doc, '$."' || k || '"'), 'null')))), ';') AS metadata FROM j""",
    "token_estimates": f"WITH {_M} SELECT id, ceil(strlen(content) / 4.0)::INT AS tokens FROM m",
    "health_counts": f"""
WITH {_M}, {_O}, a AS (
  SELECT count(*) FILTER (WHERE status = 'active') AS active_records, count(*) FILTER (WHERE status = 'deleted') AS tombstoned_records,
         count(*) FILTER (WHERE status = 'active' AND NOT coalesce(len(embedding) = embedding_dims, false)) AS unindexed FROM m),
b AS (SELECT count(DISTINCT operation_id) AS pending_operations FROM operations WHERE lower(trim(state)) = 'pending')
SELECT active_records, tombstoned_records, pending_operations, unindexed = 0 AS is_healthy, unindexed > 0 AS rebuild_required FROM a, b""",
    "ops_idempotent": f"WITH {_O} SELECT operation_id, memory_id, kind, state, created_at_ms, revision, deliveries FROM o",
    "ops_pending": f"WITH {_O} SELECT operation_id, memory_id, kind, created_at_ms FROM o WHERE state = 'pending'",
    "update_conflicts": f"""
WITH RECURSIVE {_O}, w AS (
  SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY at_ms, rev, operation_id) AS n FROM k WHERE kind IN ('remember', 'update', 'delete')),
z AS (
  SELECT memory_id, n, operation_id, kind, revision, NULL::BIGINT AS before_rev, kind = 'remember' AS alive, CASE WHEN kind = 'remember' THEN revision END AS cur, false AS hit, false AS there
  FROM w WHERE n = 1
  UNION ALL
  SELECT w.memory_id, w.n, w.operation_id, w.kind, w.revision, CASE WHEN z.alive THEN z.cur END,
         CASE w.kind WHEN 'remember' THEN true WHEN 'delete' THEN false ELSE z.alive END,
         CASE WHEN w.kind <> 'update' THEN w.revision WHEN z.alive AND coalesce(w.revision = z.cur + 1, false) THEN w.revision ELSE z.cur END,
         z.alive AND coalesce(w.revision = z.cur + 1, false), z.alive
  FROM z JOIN w ON w.memory_id = z.memory_id AND w.n = z.n + 1)
SELECT memory_id, operation_id, revision, before_rev AS current_revision, CASE WHEN NOT there THEN 'not_found' WHEN hit THEN 'applied' ELSE 'revision_conflict' END AS outcome
FROM z WHERE kind = 'update'""",
    "recovery_replay": f"""
WITH {_M}, {_O} SELECT k.memory_id, operation_id, k.kind,
  CASE WHEN k.kind = 'delete' THEN 'remove' WHEN m.id IS NULL THEN 'left' WHEN m.status IN ('pending', 'active') THEN 'upsert' ELSE 'applied' END AS action
FROM k LEFT JOIN m ON m.id = k.memory_id WHERE state = 'pending' AND k.kind IN ('remember', 'update', 'delete')""",
    "mem_tombstones": f"""
WITH {_O}, l AS (
  SELECT * FROM k WHERE kind IN ('remember', 'delete') QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY at_ms DESC, rev DESC, operation_id DESC) = 1)
SELECT memory_id, operation_id FROM l WHERE kind = 'delete'""",
    "store_lifecycle": f"""
WITH {_M} SELECT id AS memory_id, trim(tenant_id) AS tenant_id, trim(namespace) AS namespace, content, kind, CASE WHEN kind = 'fact' THEN 0.25 ELSE coalesce(importance, 0.5) END AS importance,
  'active' AS status, CASE WHEN kind = 'fact' THEN 2 ELSE 1 END::BIGINT AS revision, true AS hashed
FROM m WHERE coalesce(trim(tenant_id), '') <> '' AND coalesce(trim(namespace), '') <> '' AND coalesce(trim(content), '') <> '' AND len(embedding) = 96
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND coalesce(importance, 0.5) BETWEEN 0 AND 1 AND status <> 'deleted' AND coalesce(expires_at_ms, {_NOW} + 1) > {_NOW}""",
    "index_reopened": _batch_of("l2", "id > 20"),
    "vec_filter_test": f"WITH {_V} SELECT id, has AND parity = 'odd' AND label IN ('3', '4', '5') AS passes FROM v WHERE id % 100 = 0",
    "fts_query_terms": f"WITH {_M}, {_R}, {_FTS}, {_SEARCH.replace('{asked}', 'true')} SELECT qid, CASE WHEN len(terms) > 0 THEN array_to_string(list_concat([whole], terms), '|') ELSE '' END AS phrases FROM q1",
    "fts_vocabulary": f"WITH {_M}, {_FTS} SELECT term, df, cf FROM df",
    "fts_search": f"WITH {_M}, {_R}, {_FTS}, {_SEARCH.replace("{asked}", "true")} SELECT qid, id, round(bm25, 6) AS bm25, trank AS rank FROM txt",
    "recall_invalid": f"SELECT request_id, {_REASON} AS reason FROM recall_requests WHERE ({_REASON}) IS NOT NULL",
    "rrf_fusion": f"WITH {_M}, {_R}, {_FTS}, {_SEARCH.replace("{asked}", _ASKED)}, {_POOL} SELECT qid, id, vrank, trank, round(rrf, 9) AS rrf FROM pool",
    "recall_scored": f"{_RECALL} SELECT qid, id, round(score, 6) AS score, position FROM ({_TOP})",
    "recall_explained": f"""
{_RECALL} SELECT qid, id, round(score, 6) AS score, round(similarity, 6) AS similarity, round(importance_score, 6) AS importance_score, round(recency, 6) AS recency,
  round(reinforcement, 6) AS reinforcement, 'default_v1_scoring' || CASE WHEN trank IS NOT NULL THEN ',fts5_lexical_candidate' ELSE '' END
  || CASE WHEN trank IS NOT NULL AND vrank IS NOT NULL THEN ',reciprocal_rank_fusion' ELSE '' END AS notes FROM s""",
    "recall_agent_scope": f"""
{_RECALL} SELECT qid, id, round(score, 6) AS score FROM s WHERE (q_agent IS NULL OR agent_id = q_agent) AND (q_user IS NULL OR user_id = q_user)""",
    "recall_mmr": f"WITH RECURSIVE {_DIVERSE} SELECT qid, id, round(score, 6) AS score, round(mmr, 6) AS mmr, step::INT AS position FROM z WHERE chosen",
    "recall_full": f"""
WITH RECURSIVE {_DIVERSE}, f AS (
  SELECT qid, id, score, position FROM ({_TOP}) WHERE mmr_lambda IS NULL UNION ALL SELECT qid, id, score, step::INT FROM z WHERE chosen)
SELECT f.qid, f.id, m.kind, round(score, 6) AS score, position, count(*) OVER (PARTITION BY f.qid) AS returned FROM f JOIN m USING (id)""",
    "context_lines": f"""
{_RECALL}, tp AS ({_TOP}), ln AS (SELECT qid, position, {_LINE} AS line, ceil(strlen({_LINE}) / 4.0)::INT AS tokens FROM tp),
u AS (SELECT *, (8 + sum(tokens) OVER (PARTITION BY qid ORDER BY position))::INT AS used FROM ln)
SELECT qid, position, line, tokens, used FROM u WHERE used <= 300""",
    "context_texts": f"""
{_RECALL}, tp AS ({_TOP}), ln AS (SELECT qid, position, {_LINE} AS line, ceil(strlen({_LINE}) / 4.0)::INT AS tokens FROM tp),
u AS (SELECT *, (8 + sum(tokens) OVER (PARTITION BY qid ORDER BY position))::INT AS used FROM ln),
g AS (SELECT qid, coalesce(max(used) FILTER (WHERE used <= 300), 8) AS used, coalesce(string_agg(line || chr(10), '' ORDER BY position) FILTER (WHERE used <= 300), '') AS body FROM u GROUP BY qid)
SELECT qid, CASE WHEN used + 1 <= 300 THEN used + 1 ELSE used END::INT AS tokens,
  '### Relevant Agent Memories:' || chr(10) || body || CASE WHEN used + 1 <= 300 THEN '---' ELSE '' END AS context FROM g""",
}
