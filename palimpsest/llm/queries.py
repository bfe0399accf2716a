"""Catalogue and oracle SQL of the llm problem queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.reference_sql import _M
from ..sources.tables import load
from . import formatting_dedup, mixing, neighbors, packing, pii, residue, score_fusion, subset


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return pii.personal_items(load(spark, root, "memories"), load(spark, root, "name_parts"))


def p1_redacted(spark: SparkSession, root: str) -> DataFrame:
    return pii.redact(load(spark, root, "memories"), load(spark, root, "name_parts"))


def p3_ranking(spark: SparkSession, root: str) -> DataFrame:
    return score_fusion.fused_ranking(load(spark, root, "memories"))


def p3_components(spark: SparkSession, root: str) -> DataFrame:
    return score_fusion.components(load(spark, root, "memories"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.nearest_pairs(load(spark, root, "memories"))


def p4_recall(spark: SparkSession, root: str) -> DataFrame:
    return neighbors.recall_report(load(spark, root, "memories"))


def p5_subset(spark: SparkSession, root: str) -> DataFrame:
    return subset.varied_subset(load(spark, root, "memories"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return formatting_dedup.formatting_copies(load(spark, root, "memories"))


def p7_collapsed(spark: SparkSession, root: str) -> DataFrame:
    return formatting_dedup.collapse(load(spark, root, "memories"))


def p8_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(load(spark, root, "documents"), load(spark, root, "container_sizes"))


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.report(load(spark, root, "documents"), load(spark, root, "container_sizes"))


def p8_by_characters(spark: SparkSession, root: str) -> DataFrame:
    """The report with sizes in characters, which SQL can tell: pieces, bounds, and whether the containers are within a twentieth of the bound."""
    r = packing.report(load(spark, root, "documents"), load(spark, root, "container_sizes"), measure=mixing.in_characters)
    near = (F.col("containers") >= F.col("lower_bound")) & (F.col("containers") <= F.greatest(F.col("lower_bound") * 1.05, F.col("lower_bound") + 1))
    return r.select("container_kind", "capacity", "pieces", "tokens", "lower_bound", near.alias("near_bound"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixture(load(spark, root, "documents"), load(spark, root, "mix_targets"))


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(load(spark, root, "documents"), load(spark, root, "mix_targets"))


def p9_by_characters(spark: SparkSession, root: str) -> DataFrame:
    """The mixture with sizes in characters, which SQL can tell."""
    return mixing.mixture(load(spark, root, "documents"), load(spark, root, "mix_targets"), measure=mixing.in_characters)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_documents(load(spark, root, "documents"))


def p10_flags(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_flags(load(spark, root, "documents"))


def p10_clean(spark: SparkSession, root: str) -> DataFrame:
    return residue.without_residue(load(spark, root, "documents")).select("doc_id", "lang", "source", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_redacted, p3_ranking, p3_components, p4_found, p4_recall, p5_subset, p7_found, p7_collapsed,
        p8_containers, p8_report, p8_by_characters, p9_mixture, p9_shares, p9_by_characters, p10_found, p10_flags, p10_clean,
    )
}

_SCORES = ("importance", "access_count", "last_accessed_at_ms", "created_at_ms")


def _component_sql() -> str:
    """Ranks, correlations and the first component by squaring the matrix again and again, each in SQL."""
    def clean(n: str) -> str:
        c = f"{n}::DOUBLE"
        c = f"CASE WHEN {c} < 1e11 THEN {c} * 1000 WHEN {c} >= 1e14 THEN {c} / 1000 ELSE {c} END" if n.endswith("_ms") else c
        return f"CASE WHEN {n} IS NOT NULL AND NOT isnan({n}::DOUBLE) AND {c} >= 0 THEN {c} END"

    scope = "coalesce(tenant_id, chr(1)) AS t, coalesce(namespace, chr(1)) AS ns"
    at = range(4)
    rank = "(rank() OVER (PARTITION BY t, ns ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY t, ns, {0})) / 2.0) / count({0}) OVER (PARTITION BY t, ns) - 0.5"
    corr = ", ".join(f"CASE WHEN d{i} > 1e-9 AND d{j} > 1e-9 THEN (q{min(i, j)}{max(i, j)} - a{i} * a{j}) / (d{i} * d{j}) ELSE 0 END" for i in at for j in at)
    square = "[" + ", ".join(" + ".join(f"m[{4 * i + x + 1}] * m[{4 * x + j + 1}]" for x in at) for i in at for j in at) + "]"
    trace = "({0}[1] + {0}[6] + {0}[11] + {0}[16])"
    dot = "list_sum(list_transform(range(1, 17), lambda i: c[i] * l[(i - 1) // 4 + 1] * l[(i - 1) % 4 + 1]))"
    return f"""
WITH RECURSIVE {_M},
x AS (SELECT id, {scope}, {', '.join(f'{clean(n)} AS v{i}' for i, n in enumerate(_SCORES))} FROM m),
u AS (SELECT id, t, ns, {', '.join(f'CASE WHEN v{i} IS NULL THEN 0 ELSE {rank.format(f"v{i}")} END AS u{i}' for i in at)} FROM x),
f AS (
  SELECT t, ns, count(*) AS n, {', '.join(f'avg(u{i}) AS a{i}' for i in at)}, {', '.join(f'avg(u{i} * u{j}) AS q{i}{j}' for i in at for j in at if i <= j)} FROM u GROUP BY t, ns),
g AS (SELECT *, {', '.join(f'sqrt(greatest(q{i}{i} - a{i} * a{i}, 0)) AS d{i}' for i in at)} FROM f),
c AS (SELECT *, [{corr}] AS c FROM g),
p AS (
  SELECT t, ns, 0 AS k, list_transform(c, lambda e: e / greatest({trace.format('c')}, 1e-300)) AS m FROM c
  UNION ALL
  SELECT t, ns, k + 1, list_transform(s, lambda e: CASE WHEN {trace.format('s')} > 0 THEN e / {trace.format('s')} ELSE 0 END) FROM (SELECT t, ns, k, {square} AS s FROM p WHERE k < 30)),
o AS (SELECT t, ns, m, list_position([m[1], m[6], m[11], m[16]], list_max([m[1], m[6], m[11], m[16]])) AS b FROM p WHERE k = 30),
r AS (SELECT t, ns, [m[b], m[4 + b], m[8 + b], m[12 + b]] AS l FROM o),
y AS (SELECT t, ns, CASE WHEN list_sum(list_transform(l, lambda e: e * e)) > 0 THEN list_transform(l, lambda e: e / sqrt(list_sum(list_transform(l, lambda z: z * z)))) ELSE l END AS l FROM r),
z AS (
  SELECT t, ns, CASE WHEN list_sum(l) < -1e-9 OR (abs(list_sum(l)) <= 1e-9 AND coalesce(list_filter(l, lambda e: abs(e) > 1e-9)[1], 1) < 0) THEN list_transform(l, lambda e: -e) ELSE l END AS l FROM y),
w AS (SELECT c.*, z.l, CASE WHEN {trace.format('c')} > 0 THEN {dot} / {trace.format('c')} ELSE 0 END AS share FROM c JOIN z USING (t, ns))
"""


def _scope_sql() -> str:
    return "nullif(t, chr(1)) AS tenant_id, nullif(ns, chr(1)) AS namespace"


SQL: dict[str, str] = {
    "p3_components": f"""
{_component_sql()} SELECT {_scope_sql()}, n AS items, round(share, 6) AS explained, {', '.join(f'round(l[{i + 1}], 6) + 0.0 AS {n}' for i, n in enumerate(_SCORES))} FROM w""",
    "p3_ranking": f"""
{_component_sql()}, s AS (
  SELECT u.t, u.ns, id, round({' + '.join(f'CASE WHEN d{i} > 1e-9 THEN l[{i + 1}] * (u{i} - a{i}) / d{i} ELSE 0 END' for i in range(4))}, 9) AS score FROM u JOIN w USING (t, ns))
SELECT {_scope_sql()}, id, score + 0.0 AS score, row_number() OVER (PARTITION BY t, ns ORDER BY s.score DESC, id) AS position FROM s""",
    "p8_by_characters": """
WITH k AS (SELECT container_kind, max(capacity_tokens)::BIGINT AS c FROM container_sizes WHERE container_kind IS NOT NULL AND capacity_tokens > 0 GROUP BY container_kind),
d AS (SELECT length(text) AS n FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
x AS (SELECT container_kind, c, n, unnest(range(0, greatest(ceil(n / c)::BIGINT, 1))) AS piece FROM d, k),
h AS (SELECT container_kind, c, least(c, n - piece * c) AS w, count(*) AS m FROM x GROUP BY ALL),
a AS (SELECT container_kind, c, unnest(range(0, c // 2 + 1)) AS a FROM k),
f AS (
  SELECT a.container_kind, a.a, a.c, sum(m) FILTER (WHERE w > a.c - a) AS large, sum(m) FILTER (WHERE w <= a.c - a AND w > a.c // 2) AS middle,
    coalesce(sum(m * w) FILTER (WHERE w <= a.c // 2 AND w >= a), 0) - coalesce(sum(m * (a.c - w)) FILTER (WHERE w <= a.c - a AND w > a.c // 2), 0) AS rest
  FROM a JOIN h USING (container_kind) GROUP BY ALL),
b1 AS (SELECT container_kind, max(coalesce(large, 0) + coalesce(middle, 0) + greatest(0, ceil(rest / c))) AS b FROM f GROUP BY container_kind),
g AS (
  SELECT container_kind, c, j, sum(m * CASE WHEN (w * (j + 1)) % c = 0 THEN w * j ELSE (w * (j + 1)) // c * c END) AS v FROM h, range(1, 21) AS r(j) WHERE w > 0 GROUP BY ALL),
b2 AS (SELECT container_kind, max(ceil(v / (j * c))) AS b FROM g GROUP BY container_kind)
SELECT h.container_kind, h.c AS capacity, sum(m)::BIGINT AS pieces, sum(m * w)::BIGINT AS tokens,
  greatest(any_value(b1.b), any_value(b2.b), ceil(sum(m * w) / h.c))::BIGINT AS lower_bound, true AS near_bound
FROM h JOIN b1 USING (container_kind) JOIN b2 USING (container_kind) GROUP BY h.container_kind, h.c""",
    "p9_by_characters": """
WITH d AS (SELECT doc_id, source, length(text) AS tokens FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL AND source IS NOT NULL AND length(text) > 0),
t AS (
  SELECT source, max(target_share) AS goal, min(coalesce(max_repeats, 1)) AS cap FROM mix_targets
  WHERE source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND coalesce(max_repeats, 1) > 0 GROUP BY source),
p AS (SELECT t.*, (SELECT sum(tokens) FROM d WHERE d.source = t.source) AS own FROM t WHERE source IN (SELECT source FROM d)),
c AS (
  SELECT source, cap, least(cap::DOUBLE, (SELECT sum(own) FROM p)::DOUBLE * (goal / (SELECT sum(goal) FROM p)) / own) AS copies,
         ('0x' || substr(md5('11 ' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM p),
a AS (SELECT d.*, copies, start, cap, row_number() OVER (PARTITION BY d.source ORDER BY tokens, doc_id) AS pos FROM d JOIN c USING (source)),
n AS (SELECT source, doc_id, tokens, least((floor(pos * copies + start) - floor((pos - 1) * copies + start))::INT, cap) AS copies FROM a)
SELECT source, doc_id, tokens, copies FROM n WHERE copies > 0""",
    "p4_found": """
WITH u AS (
  SELECT DISTINCT id, embedding_dims AS d, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM memories
  WHERE id IS NOT NULL AND len(embedding) = embedding_dims
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
s AS (
  SELECT a.id AS q, b.id AS o, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.d = b.d AND a.id <> b.id),
n AS (SELECT q, o FROM s WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, o) <= 5)
SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b FROM n""",
}
