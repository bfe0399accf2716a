"""Approximate nearest neighbours: vectors partitioned by the cells of a k-means codebook.

The codebook is fitted on a bounded sample, every vector is indexed in the cell of its nearest
centre, and a query looks at the cells of its ``probes`` nearest centres. How many that are is
calibrated: for a bounded set of queries the exact neighbours are found in blocks, and the probes
are widened until the recall asked for is reached. Cells are a scope of the block search
(``knn.batch_nearest``), so large cells are cut into blocks and nothing is compared across cells.

A predicate is applied before the top-k. Queries that find fewer than k rows that pass it look at
twice as many cells, again and again until all were looked at, so that a rare match isn't missed.

Defined results: as in ``knn``; vectors of another length than the codebook's are in no cell; an
empty table has no cells and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.metrics import metric_name
from . import knn
from .durable import cut

SAMPLE = 16_384  #: vectors the codebook is fitted on, at most
MOST_CELLS = 4_096
CELL_ROWS = 2_000
QUERIES = 128  #: queries of a calibration, at most
RECALL = 0.95


@dataclass
class Codebook:
    centres: np.ndarray
    metric: str
    probes: int = 1
    recall: float | None = None  #: on the calibration's queries

    def placed(self, x: np.ndarray) -> np.ndarray:
        """``x`` as cells see it: directions, except for L2."""
        if self.metric == "l2":
            return x
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The numbers of the ``n`` nearest cells of each row, nearest first."""
        c = self.centres
        n = min(n, len(c))
        far = (c * c).sum(axis=1) - 2 * self.placed(x.astype(np.float32)) @ c.T
        at = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(at, np.argsort(np.take_along_axis(far, at, axis=1), axis=1, kind="stable"), axis=1)


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        n = np.bincount(label, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, label, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c.astype(np.float32)


_USABLE = "id IS NOT NULL AND vec IS NOT NULL AND size(vec) = {d} AND NOT exists(vec, e -> e IS NULL OR isnan(e) OR abs(e) = double('inf'))"


def fit(vectors: DataFrame, dims: int, metric: str = "l2", cells: int | None = None, seed: int = 3) -> Codebook:
    """A codebook on a sample of ``id, vec``, picked by a hash of the id."""
    metric = metric_name(metric)
    rows = vectors.where(_USABLE.format(d=dims))
    n = rows.count()
    share = min(1_000_000, int(1_000_000 * SAMPLE / max(n, 1)) + 1)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < share)
    sample = picked.select("id", F.col("vec").cast("array<float>").alias("vec")).limit(int(1.2 * SAMPLE)).toArrow().sort_by("id")
    if not sample.num_rows:
        return Codebook(np.zeros((0, dims), np.float32), metric)
    book = Codebook(np.zeros((1, dims), np.float32), metric)
    x = book.placed(np.ascontiguousarray(sample["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), dtype=np.float32))
    # a codebook stays bounded; what it can't divide further is cut into blocks by the search
    k = cells or int(np.clip(round(n / CELL_ROWS), min(8, n), min(MOST_CELLS, max(1, len(x) // 8))))
    return Codebook(_lloyd(x, k, seed), metric)


def _with_cell(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])


def assigned(vectors: DataFrame, book: Codebook) -> DataFrame:
    """``vectors`` (with ``vec``) and their ``cell``; those without a usable vector are left out."""
    if not len(book.centres):
        return vectors.limit(0).withColumn("cell", F.lit(0))
    rows = vectors.where(_USABLE.format(d=book.centres.shape[1])).withColumn("vec", F.col("vec").cast("array<float>"))
    sent = vectors.sparkSession.sparkContext.broadcast(book)  # at most MOST_CELLS centres

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sent.value.nearest(x, 1)[:, 0].astype(np.int32))], names=[*b.schema.names, "cell"])

    return rows.mapInArrow(place, _with_cell(rows))


def _probing(queries: DataFrame, book: Codebook, first: int, last: int) -> DataFrame:
    """``queries`` once per cell that comes ``first`` to ``last`` (not included) in their order."""
    sent = queries.sparkSession.sparkContext.broadcast(book)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cells = sent.value.nearest(x, last)[:, first:]
            at = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
            yield pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns], pa.array(cells.ravel().astype(np.int32))], names=[*b.schema.names, "cell"])

    rows = queries.where(_USABLE.format(d=book.centres.shape[1]).replace("id IS", "qid IS")).withColumn("vec", F.col("vec").cast("array<float>"))
    return rows.mapInArrow(spread, _with_cell(rows))


def _best(found: DataFrame, k: DataFrame) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "id")  # at most k rows a round
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.join(k, "qid").where("rank <= k").select("qid", "id", "dist", "rank")


def search(queries: DataFrame, indexed: DataFrame, book: Codebook, probes: int | None = None) -> DataFrame:
    """``qid, id, dist, rank``: of each query (``qid, vec, k``) its nearest rows of ``indexed`` (``id, vec, cell``).

    ``indexed`` may be filtered. Queries with fewer than k rows go on to further cells.
    """
    q = queries.select("qid", "vec", F.col("k").cast("int").alias("k"))
    cells = len(book.centres)
    if not cells:
        return knn.batch_nearest(q, indexed.select("id", "vec").limit(0), book.metric)
    rows = indexed.select("id", "vec", "cell")
    start, end = 0, min(probes or book.probes, cells)
    found, short = None, q
    while True:
        got = knn.batch_nearest(_probing(short, book, start, end), rows, book.metric, ["cell"]).select("qid", "id", "dist")
        found = cut(got if found is None else _best(found.unionByName(got), q.select("qid", "k")).select("qid", "id", "dist"))
        if end == cells:
            break
        counts = found.groupBy("qid").count()
        short = q.join(counts, "qid", "left").where("coalesce(count, 0) < k").select("qid", "vec", "k")
        if short.isEmpty():
            break
        start, end = end, min(2 * end, cells)
    return _best(found, q.select("qid", "k"))


def calibrate(book: Codebook, vectors: DataFrame, indexed: DataFrame, k: int = 10, target: float = RECALL, seed: int = 5) -> Codebook:
    """``book`` with as few probes as reach ``target`` on a bounded sample of the vectors as queries."""
    if len(book.centres) < 2:
        return book
    dims, n = book.centres.shape[1], vectors.count()
    share = min(1_000_000, int(1_000_000 * QUERIES / max(n, 1)) + 1)
    some = vectors.where(_USABLE.format(d=dims)).where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < share).limit(QUERIES)
    q = cut(some.select(F.col("id").alias("qid"), "vec", F.lit(k).alias("k")))
    exact = knn.batch_nearest(q, vectors.select("id", "vec"), book.metric).select("qid", "id")
    at = indexed.select("id", "cell")
    wanted = exact.join(at, "id").select("qid", "cell").join(q.select("qid", "vec"), "qid").toArrow()  # QUERIES times k rows at most
    if not wanted.num_rows:
        return book
    x = wanted["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    order = book.nearest(x, len(book.centres))
    place = (order == wanted["cell"].to_numpy()[:, None]).argmax(axis=1)
    reached = np.searchsorted(np.sort(place), np.arange(len(book.centres)), side="right") / len(place)
    probes = int(np.argmax(reached >= target)) + 1
    return Codebook(book.centres, book.metric, probes, float(reached[probes - 1]))


def build(vectors: DataFrame, dims: int, metric: str = "l2", cells: int | None = None, target: float = RECALL, k: int = 10) -> tuple[DataFrame, Codebook]:
    """The rows of ``vectors`` (``id, vec``, any other columns) with their cells, and a calibrated codebook."""
    book = fit(vectors, dims, metric, cells)
    indexed = assigned(vectors, book)
    return indexed, calibrate(book, vectors, indexed, k, target)
