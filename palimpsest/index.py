"""A vector index as a facade over DataFrames: a driver-side delta and sealed Parquet or in-session parts.

Meant for interactive use; bulk data comes in as a DataFrame (``insert_frame``) and bulk search is
``operators.knn.batch_nearest`` or ``operators.ivf.search``. Explicit ids may repeat, then they come
out as often; automatic ids start at 1 and stay above every id seen. Ids from 2**63 on are rejected.

With a path, parts are numbered Parquet tables and a manifest names those that count; a new part
gets a number above all that are there, so nothing is ever overwritten. Opening reads the latest
readable manifest, or lists the finished parts where there is none. Rows not yet sealed are lost
with the session; ``flush`` (or ``compact``) seals them.

``upsert`` and ``remove`` treat an id as one record: a row counts if it is not older than the id's
latest removal, and ``search_records`` gives an id once, at its nearest vector.
"""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import validation
from .errors import StoreError
from .functions.metrics import metric_name
from .operators import filters, ivf, knn
from .sources.files import Folder

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
        T.StructField("seq", T.LongType()),
    ]
)
DELTA_ROWS = 10_000


class Index:
    def __init__(self, spark: SparkSession, dims: int, metric: str = "l2", path: str | None = None):
        if dims <= 0:
            raise StoreError("INVALID_INPUT", "dims must be greater than 0")
        self.spark, self.dims, self.metric, self.path = spark, dims, metric_name(metric), path
        self._delta: list[tuple] = []
        self._sealed: list[DataFrame] = []
        self._parts: list[int] = []
        self._cells: tuple[DataFrame, ivf.Codebook, int] | None = None
        self._next, self._seq = 1, 0
        if path:
            self._folder = Folder(spark, path)
            self._discover()

    def _discover(self) -> None:
        found = self._folder.manifest()
        done = self._folder.committed("part-")
        self._parts = [p for p in found["parts"] if p in done] if found else done
        self._sealed = [self.spark.read.schema(SCHEMA).parquet(self._at(p)) for p in self._parts]
        if found and len(self._parts) == len(found["parts"]):
            self._next, self._seq = found["next_id"], found["seq"]
        elif self._sealed:
            top = self._stored().agg(F.max("id"), F.max("seq")).first()
            self._next, self._seq = max(self._next, (top[0] or 0) + 1), top[1] or 0
        if found and found.get("cells") is not None and found["cells"]["table"] in self._folder.committed("cells-"):
            c = found["cells"]
            book = ivf.Codebook(np.array(c["centres"], np.float32).reshape(-1, self.dims), self.metric, c["probes"], c["recall"])
            self._cells = (self.spark.read.parquet(f"{self.path}/cells-{c['table']:09d}"), book, c["parts"])

    def _at(self, part: int) -> str:
        return f"{self.path}/part-{part:09d}"

    def _commit(self) -> None:
        if self.path:
            content: dict[str, Any] = {"parts": self._parts, "next_id": self._next, "seq": self._seq, "dims": self.dims, "metric": self.metric}
            if self._cells and self._cells[2] >= 0:
                book = self._cells[1]
                content["cells"] = {"table": self._table, "centres": book.centres.ravel().tolist(), "probes": book.probes, "recall": book.recall, "parts": self._cells[2]}
            self._folder.commit(content)

    # --- writing ------------------------------------------------------------------------------
    def _add(self, vector: Any, metadata: dict | None, id_: int) -> int:
        if not 0 <= id_ < 2**63:
            raise StoreError("INVALID_INPUT", "ids must be within 0 and 2**63 - 1")
        meta = {k: [v] if isinstance(v, str) else list(v) for k, v in metadata.items()} if metadata else None
        self._seq += 1
        self._delta.append((id_, validation.vector(vector, self.dims), meta, self._seq))
        self._next = max(self._next, id_ + 1)
        if len(self._delta) >= DELTA_ROWS:
            self.compact()
        return id_

    def insert(self, vector: Any, metadata: dict | None = None) -> int:
        return self._add(vector, metadata, self._next)

    def insert_with_id(self, id_: int, vector: Any, metadata: dict | None = None) -> int:
        return self._add(vector, metadata, id_)

    def insert_batch(self, vectors: Any, metadata: list[dict] | None = None) -> list[int]:
        """All vectors or none; metadata shorter than the vectors leaves the rest without."""
        if isinstance(vectors, np.ndarray):
            if vectors.dtype != np.float32 or vectors.ndim != 2:
                raise TypeError("an array must be two-dimensional float32")
            vectors = list(np.ascontiguousarray(vectors))
        checked = [validation.vector(v, self.dims) for v in vectors]
        meta = list(metadata or [])[: len(checked)]
        return [self._add(v, meta[i] if i < len(meta) else None, self._next) for i, v in enumerate(checked)]

    def upsert(self, id_: int, vector: Any, metadata: dict | None = None) -> int:
        """Give an id a vector; one that was removed is there again, with what it had before left out."""
        return self._add(vector, metadata, id_)

    def remove(self, ids: int | list[int]) -> None:
        """Hide all that the ids have so far; unknown ids are no error."""
        for i in [ids] if isinstance(ids, int) else ids:
            self._seq += 1
            self._delta.append((i, None, None, self._seq))

    def insert_frame(self, rows: DataFrame) -> None:
        """Add a DataFrame ``id, vec, metadata`` as a sealed part, without going through the driver."""
        self._seq += 1
        part = rows.select("id", F.col("vec").cast("array<float>").alias("vec"), "metadata", F.lit(self._seq).cast("bigint").alias("seq"))
        part = part.where((F.size("vec") == self.dims) & F.col("id").between(0, 2**63 - 1))
        top = self._seal(part).agg(F.max("id")).first()[0]
        self._next = max(self._next, (top or 0) + 1)
        self._commit()

    def _seal(self, part: DataFrame) -> DataFrame:
        if self.path:
            number = max([-1, *self._folder.numbers("part-")]) + 1
            part.write.mode("errorifexists").parquet(self._at(number))
            part = self.spark.read.schema(SCHEMA).parquet(self._at(number))
            self._parts.append(number)
        self._sealed.append(part)
        return part

    def compact(self) -> None:
        """Move the delta into a sealed part."""
        if self._delta:
            self._seal(self.spark.createDataFrame(self._delta, SCHEMA))
            self._delta = []
            self._commit()

    flush = compact

    def train(self, cells: int | None = None, recall: float = ivf.RECALL) -> float | None:
        """Seal, and lay out all sealed rows by cells for approximate search; the recall measured."""
        self.compact()
        rows = self._stored().where("vec IS NOT NULL")
        indexed, book = ivf.build(rows, self.dims, self.metric, cells, recall)
        if self.path:
            self._table = max([-1, *self._folder.numbers("cells-")]) + 1
            at = f"{self.path}/cells-{self._table:09d}"
            indexed.repartition("cell").write.partitionBy("cell").parquet(at)
            indexed = self.spark.read.parquet(at)
        self._cells = (indexed, book, len(self._sealed))
        self._commit()
        return book.recall

    _table = -1

    # --- reading ------------------------------------------------------------------------------
    def _stored(self) -> DataFrame:
        out = self.spark.createDataFrame([], SCHEMA)
        for part in self._sealed:
            out = out.unionByName(part)
        return out

    def _events(self) -> DataFrame:
        """All rows, delta and sealed, removals included."""
        return self._stored().unionByName(self.spark.createDataFrame(self._delta, SCHEMA))

    def _live(self, rows: DataFrame) -> DataFrame:
        gone = self._events().where("vec IS NULL").groupBy("id").agg(F.max("seq").alias("gone"))
        return rows.where("vec IS NOT NULL").join(gone, "id", "left").where("gone IS NULL OR seq > gone").select("id", "vec", "metadata")

    def frame(self) -> DataFrame:
        """All rows that count."""
        return self._live(self._events())

    def search(self, query: Any, k: int, filter: dict | filters.Filter | None = None) -> list[tuple[int, float]]:
        """The nearest rows as (id, distance), exactly."""
        q, column = self._asked(query, filter)
        if k <= 0:
            return []
        return [(r["id"], r["dist"]) for r in knn.nearest(self.frame(), q, k, self.metric, column).collect()]

    def search_records(self, query: Any, k: int, filter: dict | filters.Filter | None = None) -> list[tuple[int, float]]:
        """As ``search``, each id once, at its nearest vector."""
        q, column = self._asked(query, filter)
        rows = self.frame() if column is None else self.frame().where(column)
        near = knn.with_distance(rows, q, self.metric).groupBy("id").agg(F.min("dist").alias("dist"))
        return [(r["id"], r["dist"]) for r in near.orderBy("dist", "id").limit(max(k, 0)).collect()]

    def search_approximate(self, query: Any, k: int, filter: dict | filters.Filter | None = None, probes: int | None = None) -> list[tuple[int, float]]:
        """As ``search``, in the cells laid out by ``train`` and exactly in what came later; twice the cells until there are k rows."""
        q, column = self._asked(query, filter)
        if self._cells is None:
            return self.search(query, k, filter)
        indexed, book, parts = self._cells
        later = self.spark.createDataFrame(self._delta, SCHEMA)
        for part in self._sealed[parts:]:
            later = later.unionByName(part)
        order = book.nearest(np.array([q], np.float32), len(book.centres))[0].tolist() if len(book.centres) else []
        n = min(probes or book.probes, len(order))
        while True:
            rows = self._live(indexed.where(F.col("cell").isin(order[:n])).drop("cell").unionByName(later))
            found = [(r["id"], r["dist"]) for r in knn.nearest(rows, q, k, self.metric, column).collect()]
            if len(found) >= k or n >= len(order):
                return found
            n = min(2 * n, len(order))

    def _asked(self, query: Any, filter: dict | filters.Filter | None) -> tuple[list[float], Any]:
        where = filter if isinstance(filter, filters.Filter) else filters.from_dict(filter)
        return validation.vector(query, self.dims), where.column(F.col("metadata")) if where is not None else None

    def delta_len(self) -> int:
        return len(self._delta)

    def num_sealed(self) -> int:
        return len(self._sealed)

    def __len__(self) -> int:
        return self.frame().count()

    def is_empty(self) -> bool:
        return len(self) == 0
