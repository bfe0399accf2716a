"""Choosing a varied subset: two-round lazy greedy maximisation of a facility-location objective.

A set is worth the sum, over all records, of each record's similarity to its nearest member,
where a record counts the less the more records are like it (one over the size of its group), so
that large groups of alike records weigh about as much as small ones, and a member of another
``kind`` covers a record only partly.

Groups come from a k-means tree that is fitted on a bounded sample: a node whose vectors are
alike is a group, and its size is counted over all records near its centre; a record of no such
node is compared with all the others of its leaf. Both cost the same per record at any size.

Round one: every partition streams its records through a block of bounded size; a lazy greedy pass
keeps the best, each with the weight of the records that it covers best, and the next records join
them. Round two streams the nominees of all partitions, at most ``PARTITIONS * SPARE`` times the
size asked for, through the same block and takes the subset. The gains given are exact ones over all records,
in the order of the picks, so their sum is the objective reached.

Defined results: records with a null id or an unusable embedding don't take part (``neighbors``);
several rows of an id are one record; a null kind is a kind of its own; if there are fewer records
than asked for, all are taken; equal gains are decided by id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut
from . import neighbors
from .neighbors import Tree, unit

BLOCK_ROWS = 2_048  #: records that join those kept, in one pass of a partition
PARTITIONS = 512  #: partitions that nominate, at most
SPARE = 2  #: nominees of a pass, as a multiple of the size asked for
OTHER_KIND = 0.8  #: how far a member covers a record of another kind
ALIKE = 0.85  #: similarity from which records count as alike
SAMPLE = 16_384  #: vectors the groups' tree is fitted on, at most, per dimension


class Cover:
    """How far each record of a block covers each: cosines within a dimension, at least 0, damped between kinds."""

    def __init__(self, block: pd.DataFrame):
        self.dims, kinds = block["dims"].to_numpy(), block["kind"].fillna("\u0000").to_numpy()
        self.kinds = np.unique(kinds.astype(str), return_inverse=True)[1]
        self.x = np.zeros((len(block), int(self.dims.max(initial=0))), np.float32)
        for d in np.unique(self.dims):
            at = np.flatnonzero(self.dims == d)
            self.x[at, :d] = unit(np.stack([np.asarray(v, np.float32) for v in block["embedding"].iloc[at]]))

    def columns(self, at: np.ndarray) -> np.ndarray:
        s = np.clip(self.x @ self.x[at].T, 0, 1)
        s *= self.dims[:, None] == self.dims[at]
        return s * np.where(self.kinds[:, None] == self.kinds[at], np.float32(1), np.float32(OTHER_KIND))


def lazy_greedy(columns: Callable[[np.ndarray], np.ndarray], weight: np.ndarray, size: int) -> list[tuple[int, float]]:
    """Picks (column, gain) in order; gains only shrink, so old ones are upper bounds in a heap."""
    n = len(weight)
    gains = np.concatenate([weight @ columns(np.arange(lo, min(lo + 1024, n))) for lo in range(0, n, 1024)]) if n else np.zeros(0)
    now = np.zeros(n, np.float32)
    heap = [(-float(g), j, 0) for j, g in enumerate(gains)]
    heapq.heapify(heap)
    picks: list[tuple[int, float]] = []
    while heap and len(picks) < size:
        bound, j, when = heapq.heappop(heap)
        if when == len(picks):
            picks.append((j, -bound))
            now = np.maximum(now, columns(np.array([j]))[:, 0])
        else:
            # the heads of the heap are brought up to date together
            due = [j]
            while heap and len(due) < 32 and heap[0][2] < len(picks):
                due.append(heapq.heappop(heap)[1])
            for j, gain in zip(due, weight @ np.maximum(columns(np.array(due)) - now[:, None], 0)):
                heapq.heappush(heap, (-float(gain), j, len(picks)))
    return picks


# --- weights ------------------------------------------------------------------------------------
def _groups_above(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per unit vector its leaf, and the highest node above it whose vectors are alike and whose centre is near; else -1."""
    r, leaf, _ = neighbors.route(tree, x, 1, 0.0)
    leaf = leaf[np.diff(r, prepend=-1) != 0]  # a row equally near to several leaves visits them all, its own first
    node = np.full(len(x), -1)
    sampled = leaf // tree.below
    for above in tree.paths.T:
        at = above[sampled]
        open_ = np.flatnonzero((node < 0) & (at >= 0))
        open_ = open_[tree.alike[at[open_]] >= ALIKE]
        near = (x[open_] * tree.centroids[at[open_]]).sum(axis=1) >= np.sqrt(ALIKE)
        node[open_[near]] = at[open_[near]]
    return leaf, node


def _labelled(rows: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """``rows`` with ``leaf`` and ``node``, that of their group or -1."""
    sent = rows.sparkSession.sparkContext.broadcast(trees)  # of the bounded sample

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            leaf, node = np.full(len(b), -1, np.int64), np.full(len(b), -1, np.int32)
            dims = b["dims"].to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                tree = sent.value[int(d)]
                x = unit(np.stack([np.asarray(v, np.float32) for v in b["embedding"].iloc[at]]))
                for lo in range(0, len(at), 2048):
                    own = at[lo : lo + 2048]
                    leaf[own], node[own] = _groups_above(tree, x[lo : lo + 2048])
            yield b.assign(leaf=leaf, node=node)

    return rows.mapInPandas(label, "id string, kind string, dims int, embedding array<float>, leaf bigint, node int")


def _alike_in_leaf(leaf: pd.DataFrame) -> pd.DataFrame:
    """The records of a leaf, each with one over the number of those that are alike."""
    leaf = leaf.sort_values("id")
    x = unit(np.stack([np.asarray(v, np.float32) for v in leaf["embedding"]]))
    alike = np.concatenate([(x[lo : lo + 512] @ x.T >= ALIKE).sum(axis=1) for lo in range(0, len(x), 512)])
    return leaf[["id", "kind", "dims", "embedding"]].assign(weight=1.0 / np.maximum(alike, 1))


def _weighted(rows: DataFrame) -> DataFrame:
    """``id, kind, dims, embedding, weight``, the weight being one over the number of records in a record's group."""
    counts = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}
    trees = {}
    for d, (x, _) in neighbors._picked(rows, counts, SAMPLE, 5).items() if counts else ():
        trees[d] = neighbors.fit(unit(x), counts[d])
    labelled = _labelled(rows, trees)
    sizes = {(r["dims"], r["node"]): r["count"] for r in labelled.where("node >= 0").groupBy("dims", "node").count().collect()}  # of the sampled trees' nodes
    table = labelled.sparkSession.createDataFrame([(d, n, 1.0 / c) for (d, n), c in sizes.items()], "dims int, node int, weight double")
    grouped = labelled.where("node >= 0").join(F.broadcast(table), ["dims", "node"]).select("id", "kind", "dims", "embedding", "weight")
    mixed = labelled.where("node < 0").select("id", "kind", "dims", "embedding", "leaf")
    alone = mixed.groupBy("dims", "leaf").applyInPandas(_alike_in_leaf, "id string, kind string, dims int, embedding array<float>, weight double")
    return grouped.unionByName(alone)


# --- rounds -------------------------------------------------------------------------------------
def _nominate(block: pd.DataFrame, size: int) -> pd.DataFrame:
    """The picks of a block in order, each with the weight of the records that it covers best."""
    block = block.sort_values("id").reset_index(drop=True)
    cover, dims = Cover(block), block["dims"].to_numpy()
    weight = block["weight"].to_numpy()
    picks = [j for j, _ in lazy_greedy(cover.columns, weight.astype(np.float32), size)]
    # a dimension without a pick covers nothing here but may in the whole: its heaviest record stands for it
    at = np.array(picks + [int(np.where(dims == d, weight, -1).argmax()) for d in np.setdiff1d(dims, dims[picks])], np.int64)
    best = np.zeros(len(block), np.int64)
    for lo in range(0, len(block), 1024):
        part = np.arange(lo, min(lo + 1024, len(block)))
        reach = cover.columns(part)[at] + (dims[at][:, None] == dims[part][None, :])
        best[part] = reach.argmax(axis=0)
    mass = np.bincount(best, weights=weight, minlength=len(at))
    out = block.iloc[at][["id", "kind", "dims", "embedding"]]
    return out.assign(weight=mass, pick=[*range(1, len(picks) + 1), *[None] * (len(at) - len(picks))])


def _streamed(size: int, block_rows: int):
    """Nominees of any number of records: those kept so far and the next ``block_rows`` make a block."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, held, n = None, [], 0
        for b in batches:
            for lo in range(0, len(b), block_rows):
                held.append(b.iloc[lo : lo + block_rows])
                n += len(held[-1])
                if n >= block_rows:
                    kept = _nominate(pd.concat([*([kept] if kept is not None else []), *held]).drop(columns="pick", errors="ignore"), size)
                    held, n = [], 0
        if n:
            kept = _nominate(pd.concat([*([kept] if kept is not None else []), *held]).drop(columns="pick", errors="ignore"), size)
        if kept is not None:
            yield kept.astype({"pick": "Int32"})

    return stream


def _gains(rows: DataFrame, picks: list) -> DataFrame:
    """``pick, gain``: what each pick adds to the cover of all ``rows`` by those before it."""

    def partial(parts):
        total = np.zeros(len(picks))
        for part in parts:
            for lo in range(0, len(part), 4_096):
                b = part.iloc[lo : lo + 4_096]
                dims, kinds = b["dims"].to_numpy(), b["kind"].fillna("\u0000").to_numpy()
                cover = np.zeros((len(b), len(picks)), np.float32)
                for d in np.unique(dims):
                    of = [j for j, p in enumerate(picks) if p["dims"] == d]
                    if of:
                        x = unit(np.stack([np.asarray(v, np.float32) for v in b["embedding"][dims == d]]))
                        y = unit(np.stack([np.asarray(picks[j]["embedding"], np.float32) for j in of]))
                        cover[np.ix_(np.flatnonzero(dims == d), of)] = np.clip(x @ y.T, 0, 1)
                own = np.array(["\u0000" if p["kind"] is None else p["kind"] for p in picks], object)
                cover *= np.where(kinds[:, None] == own[None, :], np.float32(1), np.float32(OTHER_KIND))
                reached = np.maximum.accumulate(cover, axis=1)
                total += b["weight"].to_numpy() @ np.diff(reached, axis=1, prepend=np.float32(0))
        yield pd.DataFrame({"pick": np.arange(1, len(picks) + 1, dtype=np.int32), "gain": total})

    return rows.select("dims", "kind", "embedding", "weight").mapInPandas(partial, "pick int, gain double").groupBy("pick").agg(F.sum("gain").alias("gain"))


def varied_subset(memories: DataFrame, size: int = 200, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pick, id, kind, dims, gain``: the subset in the order it was picked."""
    keep = SPARE * size
    block_rows = max(block_rows, size)
    rows = memories.where("id IS NOT NULL AND embedding IS NOT NULL AND embedding_dims > 0 AND size(embedding) = embedding_dims AND NOT exists(embedding, e -> e IS NULL)")
    rows = rows.select("id", "kind", F.col("embedding_dims").cast("int").alias("dims"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows = rows.where("NOT exists(embedding, e -> isnan(e) OR abs(e) = float('inf')) AND exists(embedding, e -> e <> 0)")
    rows = cut(rows.groupBy("id").agg(F.min(F.struct("kind", "dims", "embedding")).alias("r")).select("id", "r.*"))
    every = cut(_weighted(rows))
    schema = "id string, kind string, dims int, embedding array<float>, weight double, pick int"
    nominated = cut(every.coalesce(PARTITIONS).mapInPandas(_streamed(keep, block_rows), schema).drop("pick"))
    # greedy picks are ordered, so those asked for come first
    chosen = cut(nominated.coalesce(1).mapInPandas(_streamed(keep, block_rows), schema).where(f"pick <= {size}").drop("weight"))
    picks = chosen.orderBy("pick").collect()  # as many as asked for
    return chosen.join(_gains(every, picks), "pick").select("pick", "id", "kind", "dims", F.round("gain", 6).alias("gain"))
