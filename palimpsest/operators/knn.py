"""Exact nearest neighbours: one query as a column expression, many queries in blocks.

A predicate is applied before the top-k, so filtered results are exact. Rows without a vector, or
with one that isn't finite, never come out; ties are ordered by id; k of 0 gives no rows and a
table smaller than k all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import EPSILON, distance, metric_name

BLOCK_ROWS = 20_000
FEW = 16_384  #: queries that are sent to all tasks, at most
FEW_ROWS = 262_144  #: rows that they may ask for together
FEW_BYTES = 64 * 1024 * 1024
DECIMALS = 9  #: distances are compared at this precision, so that the order of a sum can't decide a rank


def with_distance(vectors: DataFrame, query: list[float], metric: str, vec: str = "vec", out: str = "dist") -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    d = F.round(distance(metric, F.col(vec), q), DECIMALS)
    return vectors.withColumn(out, d).where(F.col(out).isNotNull() & ~F.isnan(out) & (F.abs(out) < float("inf")))


def nearest(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """``id, dist`` of the k nearest rows, nearest first: a filtered scan and a partial and final top-k."""
    rows = vectors if where is None else vectors.where(where)
    near = with_distance(rows.select(id_col, vec), query, metric, vec).select(id_col, "dist")
    return near.orderBy("dist", id_col).limit(max(k, 0))


def nearest_live(vectors: DataFrame, tombstones: DataFrame, query: list[float], k: int, metric: str = "cosine", id_col: str = "id", vec: str = "vec") -> DataFrame:
    """As ``nearest``, without tombstoned ids and with each id once, at its nearest vector."""
    live = vectors.select(id_col, vec).join(tombstones.select(id_col).distinct(), id_col, "left_anti")
    near = with_distance(live, query, metric, vec).groupBy(id_col).agg(F.min("dist").alias("dist"))
    return near.orderBy("dist", id_col).limit(max(k, 0))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks()
    return np.ascontiguousarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float32).reshape(len(values), -1)


def _exact(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Distances of pairs of rows in double precision."""
    q, v = q.astype(np.float64), v.astype(np.float64)
    if metric == "l2":
        return ((v - q) ** 2).sum(axis=1)
    p = np.einsum("ij,ij->i", q, v)
    if metric == "dot":
        return -p
    return 1 - p / np.maximum(np.sqrt(np.einsum("ij,ij->i", q, q)) * np.sqrt(np.einsum("ij,ij->i", v, v)), EPSILON)


def _topk(q: np.ndarray, k: np.ndarray, v: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, distance) of each query's k nearest rows, in order; of equal distances the earlier row.

    One product in single precision proposes candidates, with a margin for its error; double precision ranks them.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    qn, vn = (np.einsum("ij,ij->i", x, x, dtype=np.float64) for x in (q, v))
    for lo in range(0, len(q), 256):
        part, ks = q[lo : lo + 256], k[lo : lo + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            d = -(part @ v.T)
            size = np.sqrt(qn[lo : lo + 256])[:, None] * np.sqrt(vn.max())
            if metric == "l2":
                d = 2 * d + vn.astype(np.float32)
                size = size + vn.max()
            elif metric == "cosine":
                d = d / np.maximum(np.sqrt(qn[lo : lo + 256])[:, None] * np.sqrt(vn), EPSILON).astype(np.float32)
                size = np.ones((len(part), 1))
        d = np.where(np.isfinite(d), d, np.float32(np.finfo(np.float32).min))  # too large for single precision: let double decide
        most = int(min(ks.max(), d.shape[1]))
        edge = np.partition(d, most - 1, axis=1)[:, most - 1 : most].astype(np.float64)
        r, c = np.nonzero(d <= edge + 4e-6 * np.minimum(size, 1e300))
        exact = np.concatenate([_exact(part[r[i : i + 65_536]], v[c[i : i + 65_536]], metric) for i in range(0, len(r), 65_536)])
        exact = np.round(exact, DECIMALS)
        ok = np.isfinite(exact)
        r, c, exact = r[ok], c[ok], exact[ok]
        order = np.lexsort((c, exact, r))
        r, c, exact = r[order], c[order], exact[order]
        few = np.arange(len(r)) - np.searchsorted(r, r) < ks[r]
        out.append((r[few] + lo, c[few], exact[few]))
    return tuple(np.concatenate(a) for a in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _block_topk(metric: str):
    def compare(group: pa.Table) -> pa.Table:
        is_query = group["is_query"].to_numpy()
        qs, vs = group.filter(pa.array(is_query)), group.filter(pa.array(~is_query))
        r, c, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if qs.num_rows and vs.num_rows:
            vs = vs.take(pc.sort_indices(vs["id"]))
            r, c, exact = _topk(_matrix(qs["vec"]), qs["k"].to_numpy(), _matrix(vs["vec"]), metric)
        found = qs.select(["qid", "k"]).take(pa.array(r))
        return pa.table({"qid": found["qid"], "k": found["k"], "id": vs["id"].take(pa.array(c)), "dist": pa.array(exact, pa.float64())})

    return compare


def _nearest_to_few(queries: pa.Table, vectors: DataFrame, metric: str, key: list[str], schema: str) -> DataFrame:
    """``qid, k, id, dist``: the nearest rows per task, the queries being few enough to be sent everywhere; vectors aren't shuffled."""
    sent = vectors.sparkSession.sparkContext.broadcast(queries)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        by: dict[tuple, np.ndarray] = {}
        for i, at in enumerate(zip(*(q[c].to_pylist() for c in key))):
            if None not in at:
                by.setdefault(at, []).append(i)
        by = {at: np.array(rows) for at, rows in by.items()}
        k = q["k"].to_numpy()
        matrix = {at: _matrix(q["vec"].take(pa.array(rows))) for at, rows in by.items()}
        kept, most = None, max(int(k.sum()) * 4, 100_000)

        def best(t: pa.Table) -> pa.Table:
            t = t.take(pc.sort_indices(t, [("q", "ascending"), ("dist", "ascending"), ("id", "ascending")]))
            r = t["q"].to_numpy()
            return t.filter(pa.array(np.arange(len(r)) - np.searchsorted(r, r) < k[r]))

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.take(pc.sort_indices(t["id"]))
            groups: dict[tuple, list[int]] = {}
            for i, at in enumerate(zip(*(t[c].to_pylist() for c in key))):
                groups.setdefault(at, []).append(i)
            for at, rows in groups.items():
                if at not in by:
                    continue
                own = t.take(pa.array(rows))
                r, c, exact = _topk(matrix[at], k[by[at]], _matrix(own["vec"]), metric)
                found = pa.table({"q": pa.array(by[at][r]), "id": own["id"].take(pa.array(c)), "dist": pa.array(exact, pa.float64())})
                kept = found if kept is None else pa.concat_tables([kept, found])
                if kept.num_rows > most:
                    kept = best(kept)
        if kept is not None:
            kept = best(kept).combine_chunks()
            asked = q.select(["qid", "k"]).take(kept["q"].combine_chunks())
            yield from pa.table({"qid": asked["qid"], "k": asked["k"], "id": kept["id"], "dist": kept["dist"]}).combine_chunks().to_batches()

    return vectors.select("id", "vec", *key).mapInArrow(scan, schema)


def batch_nearest(
    queries: DataFrame, vectors: DataFrame, metric: str = "cosine", scope: list[str] | None = None, block_rows: int = BLOCK_ROWS, most: int | None = None
) -> DataFrame:
    """``qid, id, dist, rank``: for every query (``qid, vec, k`` and the scope) its k nearest rows (``id, vec``) in its scope.

    At most ``FEW`` queries with at most ``FEW_ROWS`` rows wanted are sent to all tasks, which scan the
    vectors where they lie. More queries are shuffled with the vectors: scopes are cut into blocks by
    their counted sizes, on both sides, and each pair of blocks is one matrix product in one task. The
    top-k of tasks and blocks are merged per query. Vectors are compared with queries of their own
    length only. ``most``, if known, is a bound of all k; it lets Spark cut a query's rows before they
    are shuffled.
    """
    metric = metric_name(metric)
    scope = scope or []
    usable = "vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, e -> e IS NULL OR isnan(e) OR abs(e) = double('inf'))"
    id_type, qid_type = vectors.schema["id"].dataType, queries.schema["qid"].dataType
    v = vectors.where("id IS NOT NULL").where(usable).select("id", "vec", F.size("vec").alias("dims"), *scope)
    q = queries.where("qid IS NOT NULL AND k > 0").where(usable).select("qid", "vec", F.size("vec").alias("dims"), F.col("k").cast("int").alias("k"), *scope)
    key = [*scope, "dims"]
    array = F.col("vec").cast("array<float>").alias("vec")
    schema = f"qid {qid_type.simpleString()}, k int, id {id_type.simpleString()}, dist double"
    few = q.select(*key, "qid", array, "k").limit(FEW + 1).toArrow()
    if few.num_rows <= FEW and few.nbytes <= FEW_BYTES and (pc.sum(few["k"]).as_py() or 0) <= FEW_ROWS:
        return _merged(_nearest_to_few(few, v.select("id", array, *key), metric, key, schema), most)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias(name))

    sizes = blocks(v, "vb").join(blocks(q, "qb"), key)
    vid, qid = F.xxhash64("id"), F.xxhash64("qid")
    v = v.join(sizes, key).withColumn("b", F.pmod(vid, F.col("vb")).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
    q = q.join(sizes, key).withColumn("c", F.pmod(qid, F.col("qb")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("vb") - 1)))
    both = v.select(*key, "b", "c", F.lit(False).alias("is_query"), "id", F.lit(None).cast(qid_type).alias("qid"), array, F.lit(0).alias("k")).unionByName(
        q.select(*key, "b", "c", F.lit(True).alias("is_query"), F.lit(None).cast(id_type).alias("id"), "qid", array, "k")
    )
    return _merged(both.groupBy(*key, "b", "c").applyInArrow(_block_topk(metric), schema), most)


def _merged(found: DataFrame, most: int | None) -> DataFrame:
    best = Window.partitionBy("qid").orderBy("dist", "id")  # at most k rows per block or task
    ranked = found.withColumn("rank", F.row_number().over(best))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.where("rank <= k").select("qid", "id", "dist", "rank")


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, hits, wanted, recall`` of approximate (qid, id) against exact ones."""
    hits = exact.select("qid", "id").join(found.select("qid", "id").distinct().withColumn("hit", F.lit(1)), ["qid", "id"], "left")
    return hits.agg(
        F.countDistinct("qid").alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("wanted")
    ).withColumn("recall", F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("hits") / F.col("wanted")))


def append_ids(existing: DataFrame, new: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """``new`` with ids above the highest one in use, from 1 in an empty table, in the order given."""
    from .ordered import running_totals

    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint")).first()[0]
    numbered = running_totals(new.withColumn("__all", F.lit(0)), ["__all"], [F.col(c) for c in order], None, "__n")
    return numbered.withColumn(id_col, (F.col("__n").cast("bigint") + F.lit(top))).drop("__n", "__all")
