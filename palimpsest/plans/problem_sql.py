"""Oracle SQL (DuckDB) of the core problem queries, written independently of the operators."""

from __future__ import annotations

_OPS = r"""
ops AS (
  SELECT max(memory_id) AS memory_id, operation_id, max(lower(trim(kind, ' ' || chr(9) || chr(10) || chr(13)))) AS kind,
         coalesce(min(created_at_ms), -9223372036854775807) AS at_ms,
         coalesce(max(TRY_CAST(nullif(regexp_extract(payload_json, '"revision"\s*:\s*"?(\d+)"?\s*[,}]', 1), '') AS BIGINT)), -9223372036854775807) AS rev,
         max(CASE WHEN json_valid(payload_json) AND payload_json <> '{}' THEN payload_json END) AS payload
  FROM operations WHERE trim(coalesce(memory_id, '')) <> '' GROUP BY operation_id),
known AS (SELECT * FROM ops WHERE kind IN ('remember', 'update', 'delete')),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY at_ms, rev, operation_id) AS n FROM known),
base AS (
  SELECT memory_id, max(n) AS n0 FROM placed WHERE kind <> 'update' GROUP BY memory_id),
alive AS (
  SELECT p.* FROM placed p JOIN base b USING (memory_id)
  JOIN placed r ON r.memory_id = b.memory_id AND r.n = b.n0 AND r.kind = 'remember'
  WHERE p.n >= b.n0)
"""

_HISTORY = """
told AS (
  SELECT id, updated_at_ms AS at_ms, revision, round(importance, 4) AS imp, lower(trim(status, ' ' || chr(9) || chr(10) || chr(13))) AS st
  FROM (SELECT id, updated_at_ms, revision, importance, status FROM memory_snapshots
        UNION ALL SELECT id, updated_at_ms, revision, importance, status FROM memories)
  WHERE id IS NOT NULL AND updated_at_ms IS NOT NULL AND importance IS NOT NULL AND NOT isnan(importance) AND trim(status) <> ''),
one AS (
  SELECT * FROM told
  QUALIFY row_number() OVER (PARTITION BY id, at_ms ORDER BY revision DESC NULLS LAST, imp DESC, st DESC) = 1),
steps AS (
  SELECT *, lag(imp) OVER w AS p_imp, lag(st) OVER w AS p_st FROM one WINDOW w AS (PARTITION BY id ORDER BY at_ms)),
kept AS (SELECT * FROM steps WHERE p_imp IS NULL OR p_imp <> imp OR p_st <> st)
"""

SQL: dict[str, str] = {
    "p2_found": f"""
WITH {_OPS}
SELECT memory_id, operation_id FROM alive QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY n DESC) = 1""",
    "p2_state": f"""
WITH {_OPS}
SELECT memory_id, max_by(operation_id, n) AS operation_id, nullif(max_by(rev, n), -9223372036854775807) AS revision,
  max_by(TRY_CAST(json_extract_string(payload, '$.importance') AS DOUBLE), n)
    FILTER (WHERE json_extract_string(payload, '$.importance') IS NOT NULL) AS importance,
  max_by(json_extract_string(payload, '$.kind'), n) FILTER (WHERE json_extract_string(payload, '$.kind') IS NOT NULL) AS memory_kind,
  max_by(json_extract_string(payload, '$.tenant_id'), n) FILTER (WHERE json_extract_string(payload, '$.tenant_id') IS NOT NULL) AS tenant_id,
  max_by(json_extract_string(payload, '$.namespace'), n) FILTER (WHERE json_extract_string(payload, '$.namespace') IS NOT NULL) AS namespace
FROM alive GROUP BY memory_id""",
    "p6_found": f"""
WITH {_HISTORY}
SELECT id, at_ms AS valid_from_ms, coalesce(lead(at_ms) OVER (PARTITION BY id ORDER BY at_ms), -1) AS valid_to_ms FROM kept""",
    "p6_history": f"""
WITH {_HISTORY}
SELECT id, at_ms AS valid_from_ms, coalesce(lead(at_ms) OVER (PARTITION BY id ORDER BY at_ms), -1) AS valid_to_ms,
       revision, imp AS importance, st AS status FROM kept""",
}
