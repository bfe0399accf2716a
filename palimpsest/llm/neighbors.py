"""The most similar vectors for every vector: a hierarchical k-means tree, best bin first.

Per dimension a tree of spherical k-means nodes is fitted on a bounded sample (``SAMPLE`` vectors);
every row is indexed in its leaf. Where the table is too large for the sample to give leaves of
``LEAF_ROWS``, the tree goes on below its nodes with codebooks of residuals that all nodes share,
one level after the other, so that leaves grow in number and not in size. A query visits leaves in
the order of a priority queue over the tree's nodes. How far it goes is calibrated: for a bounded
set of queries the true neighbours are found by brute force over all rows, and the visits are
widened (number of leaves, and how much less similar than the best bin a leaf may be) until the
recall asked for is reached.

Neighbouring leaves make a shard, and a vector is shuffled once per shard with the leaves it
visits there, however many they are; within a shard a leaf is a few matrix products. A pair is seen
if either of the two visits the other's leaf. Shards that the sample shows to hold too many rows, or
to get too many visitors, are cut into parts on both sides. Rows with the same vector are one
query and at most ``K + 1`` index entries (more copies can't be among anyone's nearest K), so a
group of copies of any size costs a row per batch.

Defined results: rows with a null id, and vectors that are null, not of ``embedding_dims``
elements, not finite, or all zero, take part in nothing; several rows of one id with one vector
are one; among equal similarities (6 decimals) the smaller id comes first; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import cut, sweep

K = 5
MIN_SIMILARITY = 0.85
SAMPLE = 32_768  #: vectors a tree is fitted on, at most, per dimension
QUERIES = 512  #: queries the visits are calibrated with, at most, per dimension
TRUTH = 4 * K  #: vectors that a brute-force search keeps
SPREAD = 8_192  #: rows that tell what will be sent, at most, per dimension
HELD_OUT = 256  #: further queries, at most, that recall is measured on
LEAF_ROWS = 512
LEAF_SAMPLE = 8  #: vectors of the sample in a leaf, about, at least
SHARD_ROWS = 12_288
SHARD_LEAVES = 65_536  #: leaves of a shard, at most: their numbers are sent in two bytes each
PART_ROWS = 32_768  #: rows, and visitors, of a shard in one task, about, at most
FANOUT = 16
CODES = 256  #: residuals of a level below the sampled tree, at most
RECALL = 0.997
WIDEST = 64  #: leaves a calibration looks at first
BEAM = 32  #: nodes looked at on each level below the sampled tree
COPIES = 200_000  #: copies of one vector in one task, about
TASK_BYTES = 32 * 1024 * 1024  #: sent to one task, about
ONCE = 2.5  #: sendings of a row, on average, that are on disk at once
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


@dataclass
class Tree:
    """Nodes in breadth-first order; node 0 is the root. A leaf is numbered (node's number, codes below it)."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: list[int]  #: number of the sampled leaf, or -1
    at: list[int] = field(default_factory=list)  #: node of each sampled leaf
    codes: list[np.ndarray] = field(default_factory=list)  #: residuals, per level below
    shard_of: list[int] = field(default_factory=list)  #: shard of each sampled leaf
    inside: list[int] = field(default_factory=list)  #: number of each sampled leaf in its shard
    shard_leaves: int = 1  #: leaves of a shard, if there are levels below
    alike: np.ndarray = field(default_factory=lambda: np.zeros(0))  #: mean similarity of two vectors of each node; -1 where few tell it
    paths: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))  #: nodes from the root to each sampled leaf, then -1
    parts: dict[int, tuple[int, int]] = field(default_factory=dict)  #: (blocks of rows, blocks of visitors) of shards with more than one
    sendings: float = 1.0  #: shards that a row goes to, on average
    visits: int = 1
    slack: float = 2.0

    @property
    def below(self) -> int:
        return int(np.prod([len(c) for c in self.codes], dtype=np.int64))

    @property
    def leaves(self) -> int:
        return len(self.at) * self.below

    def shards(self, leaf: np.ndarray) -> np.ndarray:
        return leaf // self.shard_leaves if self.codes else np.array(self.shard_of, np.int64)[leaf]

    def rounds(self, shard: np.ndarray, rounds: int) -> np.ndarray:
        """The round of each shard; neighbouring shards share one, as rows go to neighbouring shards."""
        shards = -(-self.leaves // self.shard_leaves) if self.codes else max(self.shard_of) + 1
        return shard * rounds // shards


def unit(x: np.ndarray, dtype: type = np.float32) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(dtype)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Labels of a spherical k-means, seeded far apart."""
    centres = [x[rng.integers(len(x))]]
    near = x @ centres[0]
    for _ in range(k - 1):
        p = np.clip(1 - near, 0, None).astype(np.float64)
        if p.sum() <= 1e-9:
            break
        centres.append(x[rng.choice(len(x), p=p / p.sum())])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    labels = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        labels = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, labels, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.maximum(norms, 1e-12), c)
    return labels


def _residuals(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of a k-means of residuals."""
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    labels = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        labels = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        n = np.bincount(labels, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, labels, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c, labels


def fit(x: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Tree:
    """A tree on unit vectors ``x``, a sample of ``rows`` rows."""
    rng = np.random.default_rng(seed)
    scale = rows / max(len(x), 1)
    smallest = max(leaf_rows, LEAF_SAMPLE * scale)

    def centre(part: np.ndarray) -> tuple[np.ndarray, float]:
        c, m = x[part].sum(axis=0), len(part)
        n = np.linalg.norm(c)
        alike = (n * n - m) / (m * (m - 1)) if m >= LEAF_SAMPLE else -1.0
        return (c / n if n > 0 else x[part[0]]), float(alike)

    tree = Tree(np.zeros((0, x.shape[1]), np.float32), [], [])
    centroids: list[np.ndarray] = []
    sizes: list[float] = []
    alike: list[float] = []
    above: list[int] = []
    home = np.zeros(len(x), np.int64)
    queue = [(np.arange(len(x)), -1)]
    while queue:
        part, parent = queue.pop(0)
        node = len(centroids)
        c, a = centre(part)
        centroids.append(c)
        alike.append(a)
        above.append(parent)
        sizes.append(len(part) * scale)
        tree.children.append([])
        tree.leaf.append(-1)
        if parent >= 0:
            tree.children[parent].append(node)
        k = int(min(FANOUT, np.ceil(sizes[node] / smallest)))
        groups = []
        if k > 1:
            labels = _kmeans(x[part], k, rng)
            groups = [part[labels == g] for g in range(labels.max() + 1) if (labels == g).any()]
        if len(groups) > 1:
            queue += [(g, node) for g in groups]
        else:
            tree.leaf[node] = len(tree.at)
            home[part] = len(tree.at)
            tree.at.append(node)
    tree.centroids = np.stack(centroids).astype(np.float32)
    rest = x - tree.centroids[np.array(tree.at)][home]
    while rows / tree.leaves > 1.5 * leaf_rows and np.abs(rest).max() > 1e-6:
        codes, labels = _residuals(rest, int(min(CODES, np.ceil(rows / tree.leaves / leaf_rows))), rng)
        tree.codes.append(codes.astype(np.float32))
        rest = rest - codes[labels]
    tree.alike = np.array(alike)
    lines = []
    for node in tree.at:
        line = [node]
        while above[line[-1]] >= 0:
            line.append(above[line[-1]])
        lines.append(line[::-1])
    tree.paths = np.array([line + [-1] * (max(map(len, lines)) - len(line)) for line in lines])
    _shard(tree, sizes, rows)
    return tree


def _shard(tree: Tree, sizes: list[float], rows: int) -> None:
    """Pack neighbouring leaves into shards, in the order of the tree."""
    tree.shard_leaves = max(1, min(SHARD_LEAVES, int(SHARD_ROWS * tree.leaves / max(rows, 1))))
    tree.shard_of, tree.inside = [0] * len(tree.at), [0] * len(tree.at)
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order += [node] if tree.leaf[node] >= 0 else []
        stack += reversed(tree.children[node])
    shard, held, number = 0, 0.0, 0
    for node in order:
        if held and (held + sizes[node] > SHARD_ROWS or number == SHARD_LEAVES):
            shard, held, number = shard + 1, 0.0, 0
        held += sizes[node]
        tree.shard_of[tree.leaf[node]], tree.inside[tree.leaf[node]] = shard, number
        number += 1


def _spread(tree: Tree, x: np.ndarray, rows: int) -> None:
    """Cut shards that hold too much, as far as the sample ``x`` of ``rows`` rows shows, and count what will be sent."""
    own: dict[int, int] = {}
    came: dict[int, int] = {}
    for lo in range(0, len(x), 1024):
        r, leaf, _ = route(tree, x[lo : lo + 1024], tree.visits, tree.slack)
        shard = tree.shards(leaf)
        first = np.diff(r, prepend=-1) != 0
        pairs = np.unique(np.stack([r, shard]), axis=1)
        for counts, at in ((own, shard[first]), (came, pairs[1])):
            for s, n in zip(*np.unique(at, return_counts=True)):
                counts[int(s)] = counts.get(int(s), 0) + int(n)
    scale = rows / max(len(x), 1) / PART_ROWS
    cut = {s: (max(1, int(np.ceil(own.get(s, 0) * scale))), max(1, int(np.ceil((n - own.get(s, 0)) * scale)))) for s, n in came.items()}
    tree.parts = {s: p for s, p in cut.items() if p != (1, 1)}
    tree.sendings = sum(came.values()) / max(len(x), 1)


def route(tree: Tree, x: np.ndarray, visits: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-bin-first visits of unit vectors: (row, leaf, gap), by row, own leaf first; all rows are routed together.

    In a priority queue of unopened nodes a leaf comes up when the least similar node on the way to it
    has come up, so that one decides its turn; among leaves that wait for the same node the more
    similar one comes first, and those whose turn comes together with the last one's are visited too. With the similarities of all nodes from one product, every row's queue is
    run at once, at a cost that the bounded size of the sampled tree bounds. ``gap`` is how much less
    similar the leaf is than the row's first leaf; one too far off counts as visited all the same.
    """
    n, at = len(x), np.array(tree.at)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    keys = x @ tree.centroids.T
    turn = keys.copy()
    turn[:, 0] = np.inf
    for depth in range(1, tree.paths.shape[1]):
        nodes, first = np.unique(tree.paths[:, depth], return_index=True)
        parents = tree.paths[first, depth - 1]
        nodes, parents = nodes[nodes >= 0], parents[nodes >= 0]
        turn[:, nodes] = np.minimum(turn[:, nodes], turn[:, parents])
    keys, turn = keys[:, at], turn[:, at]
    best = np.where(turn == turn.max(axis=1, keepdims=True), keys, -np.inf).argmax(axis=1)
    pops = min(max(visits, BEAM) if tree.codes else visits, len(at))
    near = turn >= np.partition(turn, len(at) - pops, axis=1)[:, len(at) - pops : len(at) - pops + 1]
    top = keys[np.arange(n), best]
    if not tree.codes:
        near &= top[:, None] - keys <= slack
    near[np.arange(n), best] = True
    r, l = np.nonzero(near)
    order = np.lexsort((-keys[r, l], -turn[r, l], l != best[r], r))
    r, l = r[order], l[order]
    s = keys[r, l]
    if tree.codes:
        return _descend(tree, x, r, l, s, visits, slack)
    return r, l, top[r] - s


def _ranks(r: np.ndarray) -> np.ndarray:
    """The place of each entry among those of its row; ``r`` is sorted."""
    starts = np.flatnonzero(np.diff(r, prepend=-1))
    return np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))


def _descend(tree: Tree, x: np.ndarray, r: np.ndarray, l: np.ndarray, s: np.ndarray, visits: int, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From sampled leaves down the shared levels: a child's centroid is its parent's plus a residual, scaled to length 1.

    A row's own leaf lies below the best child of its own node on each level, whatever the visits. The
    others follow by similarity, of ``BEAM`` nodes on each level.
    """
    base = tree.centroids[np.array(tree.at)]
    dot, square = (x[r] * base[l]).sum(axis=1), np.ones(len(r), np.float32)
    path, number, own = [l], l.astype(np.int64), _ranks(r) == 0
    for level, codes in enumerate(tree.codes):
        inner = (base @ codes.T)[path[0]] + sum((tree.codes[i] @ codes.T)[path[i + 1]] for i in range(level))
        dots = dot[:, None] + (x @ codes.T)[r]
        squares = np.maximum(square[:, None] + 2 * inner + (codes * codes).sum(axis=1), 1e-6)
        scores = dots / np.sqrt(squares)
        width = min(len(codes), max(visits, BEAM))
        i = np.repeat(np.arange(len(r)), width)
        j = np.argpartition(-scores, width - 1, axis=1)[:, :width].ravel()
        home = own[i] & (j == np.argmax(scores, axis=1)[i])
        order = np.lexsort((-scores[i, j], ~home, r[i]))
        i, j, own = i[order], j[order], home[order]
        few = _ranks(r[i]) < max(visits, BEAM)
        i, j, own = i[few], j[few], own[few]
        dot, square, s = dots[i, j], squares[i, j], scores[i, j]
        path, number, r = [*[p[i] for p in path], j], number[i] * len(codes) + j, r[i]
    best = np.full(len(x), -np.inf, np.float32)
    best[r[own]] = s[own]
    gap = best[r] - s
    near = own | ((gap <= slack) & (_ranks(r) < visits))
    return r[near], number[near], gap[near]


# --- rows of a batch ----------------------------------------------------------------------------
def _vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, row numbers, vectors) of the usable rows of a batch with columns ``dims`` and ``embedding``."""
    dims = batch.column("dims").to_numpy(zero_copy_only=False)
    emb = batch.column("embedding")
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        x = emb.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(d))
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield int(d), at[ok], np.ascontiguousarray(x[ok], dtype=np.float32) + np.float32(0)  # -0 is 0


def _keys(vectors: list[bytes], d: int) -> list[bytes]:
    salt = d.to_bytes(4, "little")
    return [hashlib.blake2b(v, digest_size=16, salt=salt).digest() for v in vectors]


def _packed(ids: list[str], uuids: bool) -> list[bytes]:
    return [bytes.fromhex(i.replace("-", "")) for i in ids] if uuids else [i.encode() for i in ids]


def _groups(vectors: list[bytes], ids: list[bytes]) -> dict[bytes, tuple[int, set[bytes]]]:
    """Per distinct vector its first row and its ids."""
    out: dict[bytes, tuple[int, set[bytes]]] = {}
    for i, (k, v) in enumerate(zip(vectors, ids)):
        if k in out:
            out[k][1].add(v)
        else:
            out[k] = (i, {v})
    return out


def usable(memories: DataFrame) -> DataFrame:
    """``id, dims, embedding`` of the rows whose embedding has the right length; the rest is checked in batches."""
    return memories.where(
        "id IS NOT NULL AND embedding IS NOT NULL AND embedding_dims > 0 AND size(embedding) = embedding_dims AND NOT exists(embedding, e -> e IS NULL)"
    ).select("id", F.col("embedding_dims").cast("int").alias("dims"), F.col("embedding").cast("array<float>").alias("embedding"))


def _picked(rows: DataFrame, counts: dict[int, int], size: int, seed: int) -> dict[int, tuple[np.ndarray, list[str]]]:
    """Per dimension about ``size`` vectors and their ids, picked by a hash of the id, an id once; one pass for all dimensions."""
    size = max(1, min(size, 8 * size // max(len(counts), 1)))  # what the driver holds is bounded also with many dimensions
    # ids that repeat make fewer picks than rows, never more than the limit
    share = F.coalesce(*[F.when(F.col("dims") == d, F.lit(min(1_000_000, int(1_000_000 * size / n) + 1))) for d, n in counts.items()])
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) < share).groupBy("dims", "id").agg(F.min("embedding").alias("embedding"))
    table = picked.limit(int(1.2 * size * len(counts))).toArrow().sort_by([("dims", "ascending"), ("id", "ascending")])  # in an order that doesn't hang on the tasks
    out: dict[int, tuple[np.ndarray, list[str]]] = {}
    for batch in table.combine_chunks().to_batches():
        ids = batch.column("id").to_pylist()
        for d, at, x in _vectors(batch):
            before = out.get(d, (x[:0], []))
            out[d] = (np.concatenate([before[0], x]), before[1] + [ids[i] for i in at])
    return out


def _truth(rows: DataFrame, queries: dict[int, np.ndarray]) -> dict[int, dict[int, list[tuple[float, bytes]]]]:
    """Per dimension and query the nearest ``TRUTH`` vectors, by brute force over all rows in blocks; in single precision, so with some to spare."""
    sent = rows.sparkSession.sparkContext.broadcast({d: unit(q) for d, q in queries.items()})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], dict[bytes, float]] = {}
        for batch in batches:
            for d, _, x in _vectors(batch):
                if d not in sent.value:
                    continue
                s = unit(x) @ sent.value[d].T
                for r, c in zip(*np.nonzero(s >= MIN_SIMILARITY)):
                    best.setdefault((d, int(c)), {})[x[r].tobytes()] = float(s[r, c])
            for at, found in best.items():
                if len(found) > 2 * TRUTH:
                    best[at] = dict(sorted(found.items(), key=lambda t: (-t[1], t[0]))[:TRUTH])
        out = [(*at, s, v) for at, found in best.items() for v, s in sorted(found.items(), key=lambda t: (-t[1], t[0]))[:TRUTH]]
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.binary()))], names=["dims", "q", "s", "v"])

    found = rows.mapInArrow(scan, "dims int, q int, s double, v binary")
    # every task sends at most TRUTH rows per query
    top = found.groupBy("dims", "q").agg(F.slice(F.sort_array(F.collect_set(F.struct("s", "v")), asc=False), 1, TRUTH).alias("t"))
    out: dict[int, dict[int, list[tuple[float, bytes]]]] = {d: {} for d in queries}
    for r in top.collect():
        out[r["dims"]][r["q"]] = [(t["s"], bytes(t["v"])) for t in r["t"]]
    sent.unpersist()
    return out


def calibrate(tree: Tree, queries: np.ndarray, truth: dict[int, list[tuple[float, bytes]]], target: float = RECALL) -> None:
    """Set ``tree.visits`` and ``tree.slack`` to the cheapest visits whose recall on ``queries`` reaches ``target``."""
    tree.visits, tree.slack = 1, 2.0
    if tree.leaves == 1:
        return
    pairs = [(q, v) for q, vs in truth.items() for _, v in vs[: K + 1] if v != queries[q].tobytes()]
    if not pairs:
        return
    number = {v: i for i, v in enumerate(dict.fromkeys(v for _, v in pairs))}
    asked_u = unit(queries)
    others_u = unit(np.frombuffer(b"".join(number), np.float32).reshape(len(number), -1))

    def table(x: np.ndarray, widest: int) -> list[dict[int, tuple[int, float]]]:
        out: list[dict[int, tuple[int, float]]] = [{} for _ in range(len(x))]
        for i in range(0, len(x), 512):
            for r, leaf, gap in zip(*route(tree, x[i : i + 512], widest, 4.0)):
                out[i + r][int(leaf)] = (len(out[i + r]), float(gap))
        return out

    best, never = None, (tree.leaves, np.inf)
    # more leaves are looked at only if the first ones don't do; beyond that what was reached is taken, and told by the held-out queries
    for widest in sorted({min(w, tree.leaves) for w in (WIDEST, 8 * WIDEST, 4_096)}):
        asked, others = table(asked_u, widest), table(others_u, widest)
        home = [next(iter(t)) for t in asked]
        homes = [next(iter(t)) for t in others]
        need = [(asked[q].get(homes[number[v]], never), others[number[v]].get(home[q], never)) for q, v in pairs]
        for visits in sorted({v for v in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 128, 256, 512, 1024, 2048) if v < widest} | {widest}):
            gaps = sorted(min((g for rank, g in n if rank < visits), default=np.inf) for n in need)
            at = gaps[min(len(gaps) - 1, int(np.ceil(target * len(gaps))) - 1)]
            if not np.isfinite(at):
                if best is None:
                    tree.visits, tree.slack = visits, 4.0
                continue
            slack = at + 1e-6
            cost = np.mean([sum(rank < visits and g <= slack for rank, g in t.values()) for t in asked])
            if best is None or cost < best[0]:
                best = (cost, visits, slack)
        if best is not None:
            break
    if best is not None:
        tree.visits, tree.slack = best[1], best[2]


@dataclass
class Index:
    """The usable rows with a calibrated tree per dimension."""

    rows: DataFrame
    trees: dict[int, Tree]
    counts: dict[int, int]
    uuids: bool


def index(memories: DataFrame, leaf_rows: int = LEAF_ROWS, target: float = RECALL) -> Index:
    rows = usable(memories)
    told = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(~F.col("id").rlike(_UUID)).alias("other")).collect()
    counts = {r["dims"]: r["n"] for r in sorted(told, key=lambda r: r["dims"])}
    sample = _picked(rows, counts, SAMPLE, 1) if counts else {}
    trees = {d: fit(unit(x), counts[d], leaf_rows) for d, (x, _) in sample.items()}
    branched = {d: counts[d] for d, tree in trees.items() if tree.leaves > 1}
    queries = {d: x for d, (x, _) in _picked(rows, branched, QUERIES, 2).items()} if branched else {}
    truth = _truth(rows, queries) if queries else {}
    for d, q in queries.items():
        calibrate(trees[d], q, truth[d], target)
    # rows that a tree was fitted on lie nearer to their leaves, so they visit fewer: what will be sent is counted on others
    for d, (x, _) in _picked(rows, branched, SPREAD, 4).items() if branched else ():
        _spread(trees[d], unit(x), counts[d])
    return Index(rows, trees, counts, not any(r["other"] for r in told))


_ROUTED = "dims int, shard bigint, part int, own boolean, leaves binary, vec binary, ids array<binary>, n int"


def _routed(ix: Index, rounds: int = 1, turn: int = 0) -> DataFrame:
    """What is sent to the shards of round ``turn`` of ``rounds``."""
    sent = ix.rows.sparkSession.sparkContext.broadcast(ix.trees)
    uuids = ix.uuids

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for d, at, x in _vectors(batch):
                tree = sent.value.get(d)
                if tree is None:
                    continue
                groups = _groups([v.tobytes() for v in x], _packed([ids[i] for i in at], uuids))
                vectors, members = list(groups), [g[1] for g in groups.values()]
                u = unit(x[[g[0] for g in groups.values()]])
                for lo in range(0, len(u), 1024):
                    yield _sendings(tree, d, u[lo : lo + 1024], vectors[lo : lo + 1024], members[lo : lo + 1024], rounds, turn)

    return ix.rows.mapInArrow(scan, _ROUTED)


def _sendings(tree: Tree, d: int, u: np.ndarray, vectors: list[bytes], members: list[set[bytes]], rounds: int = 1, turn: int = 0) -> pa.RecordBatch:
    """One row per vector and shard (and part of it), with the leaves visited there."""
    r, leaf, _ = route(tree, u, tree.visits, tree.slack)
    shard = tree.shards(leaf)
    home = np.diff(r, prepend=-1) != 0
    order = np.lexsort((~home, shard, r))
    order = order[tree.rounds(shard[order], rounds) == turn]
    r, leaf, shard, home = r[order], leaf[order], shard[order], home[order]
    starts = np.flatnonzero((np.diff(r, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
    ends = np.append(starts[1:], len(r))
    rows, part, own, n = [], [], [], []
    for i, s in enumerate(starts):
        at, size = int(shard[s]), len(members[r[s]])
        if at not in tree.parts:
            rows.append(i), part.append(0), own.append(bool(home[s])), n.append(size if home[s] else 0)
            continue
        blocks, chunks = tree.parts[at]
        mine, chunk = (int.from_bytes(hashlib.blake2b(vectors[r[s]], digest_size=8, salt=salt).digest(), "little") for salt in (b"row", b"visitor"))
        for b in range(blocks):
            # in its own block a row meets every chunk of visitors; elsewhere it is a visitor itself
            is_own = bool(home[s]) and b == mine % blocks
            for c in range(chunks) if is_own else (chunk % chunks,):
                rows.append(i), part.append(b * chunks + c), own.append(is_own), n.append(size if is_own and c == 0 else 0)
    at = np.array(rows, np.int64)
    inside = (leaf - shard * tree.shard_leaves if tree.codes else np.array(tree.inside, np.int64)[leaf]).astype("<u2")
    which = r[starts[at]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(at), d, np.int32)),
            pa.array(shard[starts[at]]),
            pa.array(part, pa.int32()),
            pa.array(own, pa.bool_()),
            pa.array([inside[starts[i] : ends[i]].tobytes() for i in at], pa.binary()),
            pa.array([vectors[i] for i in which], pa.binary()),
            pa.array([sorted(members[i])[: K + 1] for i in which], pa.list_(pa.binary())),
            pa.array(n, pa.int32()),
        ],
        names=["dims", "shard", "part", "own", "leaves", "vec", "ids", "n"],
    )


#: ``near`` holds 4 bytes of 1 - similarity in millionths, then the id: in the order of nearness, and short
_FOUND = "key binary, n bigint, mine array<binary>, near array<binary>"


def _leaf_pairs(u: np.ndarray, own: np.ndarray, visitors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Likely neighbours within a leaf: its rows among all, visitors among its rows; enough of each to hold the nearest K + 1."""
    every = np.concatenate([own, visitors])
    for asking, among in ((own, every), (visitors, own)):
        for lo in range(0, len(asking), 1024):
            rows = asking[lo : lo + 1024]
            s = u[rows] @ u[among].T
            floor = np.full(len(rows), MIN_SIMILARITY, np.float32)
            if len(among) > K + 1:
                floor = np.maximum(floor, np.partition(s, len(among) - K - 1, axis=1)[:, len(among) - K - 1])
            r, c = np.nonzero(s >= floor[:, None] - np.float32(4e-6))
            yield rows[r], among[c]


def _compare(group: pa.Table) -> pa.Table:
    """Nearest candidates within one part of a shard: in each leaf its own vectors and those that visit it."""
    d = group["dims"][0].as_py()
    merged: dict[bytes, list] = {}
    for own, leaves, vec, ids, n in zip(*(group[c].to_pylist() for c in ("own", "leaves", "vec", "ids", "n"))):
        m = merged.setdefault(vec, [False, leaves, set(), 0])
        m[0] |= own
        m[2].update(ids)
        m[3] += n
    vectors, items = list(merged), list(merged.values())
    u64 = unit(np.frombuffer(b"".join(vectors), np.float32).reshape(len(items), d), np.float64)
    u = u64.astype(np.float32)
    inside: dict[int, tuple[list[int], list[int]]] = {}
    for i, m in enumerate(items):
        for j, leaf in enumerate(np.frombuffer(m[1], "<u2").tolist()):
            # the first leaf of an own row is its home
            inside.setdefault(leaf, ([], []))[0 if m[0] and j == 0 else 1].append(i)
    found = [p for own, visitors in inside.values() if own for p in _leaf_pairs(u, np.array(own, np.int64), np.array(visitors, np.int64))]
    r, c = (np.concatenate(a) for a in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    both = np.unique(r * len(items) + c)
    r, c = both // max(len(items), 1), both % max(len(items), 1)
    exact = np.concatenate([np.einsum("ij,ij->i", u64[r[i : i + 65536]], u64[c[i : i + 65536]]) for i in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
    exact = np.round(exact, 6)
    r, c, exact = r[exact >= MIN_SIMILARITY], c[exact >= MIN_SIMILARITY], exact[exact >= MIN_SIMILARITY]
    lists = [sorted(m[2])[: K + 1] for m in items]
    lengths = np.array([len(v) for v in lists], np.int64)
    flat = [i for v in lists for i in v]
    place = np.empty(len(flat), np.int64)
    place[sorted(range(len(flat)), key=flat.__getitem__)] = np.arange(len(flat))
    # a pair of vectors stands for as many pairs as the second one has ids
    times = lengths[c]
    begins = np.cumsum(lengths) - lengths
    ids = np.repeat(begins[c] - (np.cumsum(times) - times), times) + np.arange(times.sum())
    r, exact = np.repeat(r, times), np.repeat(exact, times)
    order = np.lexsort((place[ids], -exact, r))
    r, exact, ids = r[order], exact[order], ids[order]
    starts = np.flatnonzero(np.diff(r, prepend=-1))
    sizes = np.diff(np.append(starts, len(r)))
    keep = np.arange(len(r)) - np.repeat(starts, sizes) < K + 1
    r, exact, ids = r[keep], exact[keep], ids[keep]
    # a row that found nothing but itself tells nothing
    alone = (np.bincount(r, minlength=len(items)) == 1) & (np.bincount(r[r == np.searchsorted(np.cumsum(lengths), ids, side="right")], minlength=len(items)) == 1)
    keep = ~alone[r]
    r, exact, ids = r[keep], exact[keep], ids[keep]
    starts = np.flatnonzero(np.diff(r, prepend=-1))
    told = r[starts].tolist()
    away = np.rint(np.clip(1 - exact, 0, None) * 1e6).astype(">u4").tobytes()
    entries = pa.array([away[4 * i : 4 * i + 4] + flat[at] for i, at in enumerate(ids)], pa.binary())
    near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(r)), pa.int32()), entries)
    return pa.table(
        {
            "key": pa.array(_keys([vectors[i] for i in told], d), pa.binary()),
            "n": pa.array([items[i][3] for i in told], pa.int64()),
            "mine": pa.array([lists[i] for i in told], pa.list_(pa.binary())),
            "near": near,
        }
    )


def _members(ix: Index, many: set[bytes], salts: int) -> DataFrame:
    """``key, salt, ids``: per batch the ids of each vector; those of the vectors ``many`` are spread over ``salts``."""
    uuids = ix.uuids
    sent = ix.rows.sparkSession.sparkContext.broadcast(many)  # at most one in COPIES rows

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for d, at, x in _vectors(batch):
                groups = _groups([v.tobytes() for v in x], _packed([ids[i] for i in at], uuids))
                keys = _keys(list(groups), d)
                salt = [int.from_bytes(hashlib.blake2b(min(g[1]), digest_size=8).digest(), "little") % salts if k in sent.value else 0 for k, g in zip(keys, groups.values())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(salt, pa.int32()), pa.array([sorted(g[1]) for g in groups.values()], pa.list_(pa.binary()))],
                    names=["key", "salt", "ids"],
                )

    return ix.rows.mapInArrow(scan, "key binary, salt int, ids array<binary>")


def _merged(found: DataFrame) -> DataFrame:
    """One row per key: all its ids told, and the nearest ``K + 1`` of all."""
    near = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, K + 1)
    return found.groupBy("key").agg(F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"), near.alias("near"))


def _pairs(ix: Index) -> DataFrame:
    spark = ix.rows.sparkSession
    # the shuffle is as wide as what is sent needs, whatever the session's setting; what is beyond ONCE is sent in further rounds
    plain = {d: n * (d * 4 + 100) for d, n in ix.counts.items() if d in ix.trees}
    width = sum(b * ix.trees[d].sendings for d, b in plain.items())
    rounds = max(1, int(np.ceil(width / (ONCE * max(1, sum(plain.values()))))))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(width / rounds // TASK_BYTES) + 1)
    told = []
    for turn in range(rounds):
        found = _routed(ix, rounds, turn).repartition(tasks, "dims", "shard", "part").groupBy("dims", "shard", "part").applyInArrow(_compare, _FOUND)
        told.append(cut(_merged(found.withColumnRenamed("mine", "ids"))))
        del found
        sweep(spark)  # what the round has sent
    merged = told[0]
    if rounds > 1:
        merged = cut(_merged(functools.reduce(DataFrame.unionByName, told)))
        told.clear()
        sweep(spark)
    both, hot = merged.where(F.col("n") <= K + 1).select("ids", "near"), merged.where(F.col("n") > K + 1)
    most = hot.agg(F.max("n")).first()[0]
    if most:
        # only vectors with more copies than a shard is told need their members; as many salts as the most copied one fills tasks
        salts = -(-most // COPIES)
        many = {bytes(r["key"]) for r in hot.where(F.col("n") > COPIES).select("key").collect()} if salts > 1 else set()
        last = F.when(F.col("n") > COPIES, F.lit(salts - 1)).otherwise(F.lit(0)).cast("int")
        salted = hot.select("key", "near", F.explode(F.sequence(F.lit(0), last)).alias("salt"))
        both = both.unionByName(_members(ix, many, salts).join(salted, ["key", "salt"]).select("ids", "near"))
    each = both.select(F.explode("ids").alias("id"), "near").select("id", F.explode(F.expr(f"slice(filter(transform(near, t -> substring(t, 5)), t -> t <> id), 1, {K})")).alias("t"))
    return each.select(F.least("id", "t").alias("a"), F.greatest("id", "t").alias("b")).distinct()


def _text(c: str, uuids: bool) -> F.Column:
    if not uuids:
        return F.decode(c, "UTF-8")
    h = F.lower(F.hex(c))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def nearest_pairs(memories: DataFrame, leaf_rows: int = LEAF_ROWS, target: float = RECALL) -> DataFrame:
    """``id_a, id_b``: pairs of which at least one is among the other's K nearest of similarity 0.85 or more."""
    ix = index(memories, leaf_rows, target)
    if not ix.trees:
        return memories.sparkSession.createDataFrame([], "id_a string, id_b string")
    return _pairs(ix).select(_text("a", ix.uuids).alias("id_a"), _text("b", ix.uuids).alias("id_b"))


def recall_report(memories: DataFrame, leaf_rows: int = LEAF_ROWS, target: float = RECALL) -> DataFrame:
    """``dims, rows, leaves, visits, slack, queries, wanted, recall``: the pairs given out against brute force.

    ``queries`` are up to ``HELD_OUT`` picked rows that the calibration didn't use, ``wanted`` their true
    neighbours; without any, recall is null.
    """
    ix = index(memories, leaf_rows, target)
    spark = memories.sparkSession
    used = _picked(ix.rows, ix.counts, QUERIES, 2) if ix.counts else {}
    picked = _picked(ix.rows, ix.counts, HELD_OUT, 3) if ix.counts else {}
    asked: dict[int, tuple[np.ndarray, list[str]]] = {}
    for d, (x, ids) in picked.items():
        calibrated = set(used[d][1]) if ix.trees[d].leaves > 1 else set()
        at = [i for i, v in enumerate(ids) if v not in calibrated]
        if at:
            asked[d] = (x[at], [ids[i] for i in at])
    schema = "dims int, rows bigint, leaves bigint, visits int, slack double, queries int, wanted bigint, recall double"
    truth = _truth(ix.rows, {d: x for d, (x, _) in asked.items()}) if asked else {}
    wanted = []  # at most TRUTH vectors a query, its own among them, for the ids that share it
    for d, found in truth.items():
        for q, near in found.items():
            u = unit(np.stack([asked[d][0][q], *[np.frombuffer(v, np.float32) for _, v in near]]), np.float64)
            wanted += [(d, asked[d][1][q], v, float(s)) for (_, v), s in zip(near, np.round(u[1:] @ u[0], 6)) if s >= MIN_SIMILARITY]
    want = F.broadcast(spark.createDataFrame(wanted, "dims int, qid string, v binary, s double").withColumn("h", F.hash("v")))
    rows = _bytes(ix.rows.select("id", "dims", "embedding")).withColumn("h", F.hash("v"))
    others = rows.join(want, ["dims", "h", "v"]).where("id <> qid").select("dims", "qid", F.col("id").alias("oid"), "s").distinct()
    best = Window.partitionBy("qid").orderBy(F.col("s").desc(), "oid")
    others = others.withColumn("rank", F.row_number().over(best)).where(f"rank <= {K}")
    given = _pairs(ix).select(_text("a", ix.uuids).alias("a"), _text("b", ix.uuids).alias("b"), F.lit(1).alias("hit"))
    both = others.withColumn("a", F.least("qid", "oid")).withColumn("b", F.greatest("qid", "oid")).join(given, ["a", "b"], "left")
    sums = {r["dims"]: r for r in both.groupBy("dims").agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits")).collect()}
    out = []
    for d, tree in ix.trees.items():
        s = sums.get(d)
        out.append((d, ix.counts[d], tree.leaves, tree.visits, float(tree.slack), s["queries"] if s else 0, s["wanted"] if s else 0, s["hits"] / s["wanted"] if s else None))
    return spark.createDataFrame(out, schema)


def _bytes(rows: DataFrame) -> DataFrame:
    """``id, dims, v``: the vectors as bytes, as they are compared."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for d, at, x in _vectors(batch):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in at], pa.string()), pa.array([d] * len(at), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "dims", "v"])

    return rows.mapInArrow(scan, "id string, dims int, v binary")
