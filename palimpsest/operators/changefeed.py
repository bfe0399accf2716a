"""Applying a change feed of inserts, updates and deletes (SQL only).

Column-wise last writer wins: for each field the value of the latest change that sets it, looking
only at changes after the latest delete or replacement. One aggregation per memory suffices,
because a field's latest change either lies after that reset and counts, or lies before it and
then no later change has set the field. Both aggregations combine on the map side, so a hot
memory or an operation delivered many times costs one partial row per task.

Defined results:

* rows of one ``operation_id`` are one operation, made at their smallest ``created_at_ms``;
  copies may disagree or be null in other fields: the greatest non-null value is taken; of a
  payload that was cut off only a revision before the cut counts;
* order is time, then ``revision`` of the payload, then ``operation_id``; an operation without
  any time comes first, one without revision before those with one;
* rows without ``memory_id`` (null or blank) don't count, nor kinds other than the three;
  a row without ``operation_id`` is an operation of its own (equal rows are one), its id null;
* ``remember`` replaces whatever is there, ``delete`` removes it, an ``update`` of a memory that
  doesn't exist at that point has no effect; an empty feed gives no rows;
* columns that aren't named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_OPERATIONS = """
SELECT max(memory_id) AS memory_id,
       max(operation_id) AS operation_id,
       max(lower(btrim(kind, ' \\t\\r\\n'))) AS op,
       coalesce(min(created_at_ms), -9223372036854775807) AS at_ms,
       coalesce(max(try_cast(regexp_extract(payload_json, '"revision"\\\\s*:\\\\s*"?(\\\\d+)"?\\\\s*[,}}}}]', 1) AS BIGINT)), -9223372036854775807) AS rev,
       max(CASE WHEN payload_json <> '{{{{}}}}' AND get_json_object(payload_json, '$') IS NOT NULL THEN payload_json END) AS payload
FROM {feed}
WHERE memory_id IS NOT NULL AND btrim(memory_id) <> ''
GROUP BY coalesce(operation_id,
                  concat('\\u0001', sha2(to_json(struct(memory_id, kind, payload_json, created_at_ms)), 256)))
"""

_PARSED = """
SELECT memory_id, operation_id, op, struct(at_ms, rev, coalesce(operation_id, '') AS tie) AS seq, rev,
       try_cast(get_json_object(payload, '$.importance') AS DOUBLE) AS importance,
       get_json_object(payload, '$.kind') AS memory_kind,
       get_json_object(payload, '$.tenant_id') AS tenant_id,
       get_json_object(payload, '$.namespace') AS namespace
FROM ({operations}) WHERE op IN ('remember', 'update', 'delete')
"""

_FIELDS = ("importance", "memory_kind", "tenant_id", "namespace")


def last_effective_operation(feed: DataFrame) -> DataFrame:
    """``memory_id, operation_id``: per existing memory the operation that last took effect."""
    spark = feed.sparkSession
    operations = _OPERATIONS.format(feed="{feed}")
    return spark.sql(
        f"""
        SELECT memory_id, operation_id FROM (
          SELECT memory_id,
                 max_by(operation_id, seq) AS operation_id,
                 max_by(op, seq) FILTER (WHERE op <> 'update') AS reset
          FROM ({_PARSED.format(operations=operations)})
          GROUP BY memory_id)
        WHERE reset = 'remember'""",
        feed=feed,
    )


def current_state(feed: DataFrame) -> DataFrame:
    """The rebuilt table: ``memory_id, operation_id, revision, importance, memory_kind, tenant_id, namespace``.

    Each field comes from the latest operation that sets it (non-null in its payload) after the
    latest delete or replacement, and is null where none did.
    """
    spark = feed.sparkSession
    latest = ",\n".join(
        f"max_by(struct(seq AS at, {c} AS v), seq) FILTER (WHERE {c} IS NOT NULL AND op <> 'delete') AS {c}" for c in _FIELDS
    )
    fields = ",\n".join(f"CASE WHEN {c}.at >= reset.at THEN {c}.v END AS {c}" for c in _FIELDS)
    return spark.sql(
        f"""
        SELECT memory_id, operation_id, CASE WHEN revision > -9223372036854775807 THEN revision END AS revision, {fields} FROM (
          SELECT memory_id,
                 max_by(operation_id, seq) AS operation_id, max_by(rev, seq) AS revision,
                 max_by(struct(seq AS at, op AS op), seq) FILTER (WHERE op <> 'update') AS reset,
                 {latest}
          FROM ({_PARSED.format(operations=_OPERATIONS.format(feed="{feed}"))})
          GROUP BY memory_id)
        WHERE reset.op = 'remember'""",
        feed=feed,
    )
