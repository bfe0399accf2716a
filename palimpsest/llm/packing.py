"""Filling containers of fixed capacity: bound-certified repacking.

Documents are split over partitions of bounded size, each packed by best-fit decreasing. Dual
feasible functions give a lower bound on the containers a partition needs; where the packing meets
it, it is certified. Partitions with a gap give up their emptiest containers, whose documents are
exchanged between partitions and packed again, as long as that saves containers.

Sizes come from a tokenizer unless another measure is given.

A text longer than the capacity is split into full containers and a rest; no other is split.

Defined results: a null text isn't placed; a blank text has no tokens and goes into any
container; sizes with a null kind or a null or non-positive
capacity are left out; of equal sizes the smaller
doc_id is placed first; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut
from .mixing import Measure
from .tokens import sizes

PART_ITEMS = 20_000
KINDS = 1_000  #: kinds of containers in one pass over the sizes
SCHEMA = "container_kind string, capacity bigint, container string, doc_id bigint, piece int, first_token bigint, tokens bigint, gap int, fullness int"


def lower_bound(weights: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers needed at least by items of ``weights``, ``counts`` of each: the best of several dual feasible functions."""
    n = np.ones(len(weights), np.int64) if counts is None else counts.astype(np.int64)
    w, n = weights[weights > 0].astype(np.int64), n[weights > 0]
    if not len(w):
        return 0
    best = -(-int((w * n).sum()) // capacity)
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, w, n)
    total = count * np.arange(capacity + 1)
    n_upto, t_upto = np.cumsum(count), np.cumsum(total)
    half = capacity // 2
    for a in range(0, half + 1):
        large = n_upto[-1] - n_upto[capacity - a]
        middle_n = n_upto[capacity - a] - n_upto[half]
        middle_t = t_upto[capacity - a] - t_upto[half]
        small_t = t_upto[half] - (t_upto[a - 1] if a else 0)
        rest = small_t - (middle_n * capacity - middle_t)
        best = max(best, int(large + middle_n + max(0, -(-int(rest) // capacity))))
    for k in range(1, 21):
        scaled = w * (k + 1)
        floor, exact = scaled // capacity, scaled % capacity == 0
        value = np.where(exact, w * k, floor * capacity)  # times k * capacity
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(weights: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item (given in decreasing order) and the free space of each container.

    Free spaces are kept as the bits of one integer, so the tightest fit is a shift and a bit scan.
    """
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free, at = 0, [], np.zeros(len(weights), np.int64)
    for i, w in enumerate(weights.tolist()):
        fits = mask >> w
        if fits:
            space = w + ((fits & -fits).bit_length() - 1)
            b = by_space[space].pop()
            if not by_space[space]:
                mask &= ~(1 << space)
        else:
            b, space = len(free), capacity
            free.append(0)
        left = space - w
        free[b] = left
        by_space[left].append(b)
        mask |= 1 << left
        at[i] = b
    return at, np.array(free, np.int64)


def _pack(part: pd.DataFrame, label: str) -> pd.DataFrame:
    capacity = int(part["capacity"].iloc[0])
    part = part.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
    w = part["tokens"].to_numpy()
    at, free = best_fit_decreasing(w, capacity)
    gap = len(free) - lower_bound(w, capacity)
    order = np.argsort(-free, kind="stable")
    place = np.empty(len(free), np.int64)
    place[order] = np.arange(len(free))
    head = f"{part['container_kind'].iloc[0]}-{label}-{part['part'].iloc[0]}-"
    return pd.DataFrame(
        {
            "container_kind": part["container_kind"].to_numpy(),
            "capacity": capacity,
            "container": [f"{head}{b}" for b in at],
            "doc_id": part["doc_id"].to_numpy(),
            "piece": part["piece"].to_numpy(),
            "first_token": part["first_token"].to_numpy(),
            "tokens": w,
            "gap": gap,
            "fullness": place[at],
        }
    )


def containers_of(container_sizes: DataFrame) -> Iterator[list[tuple[str, int]]]:
    """The kinds with their capacities, in slices of bounded number."""
    found = container_sizes.where("container_kind IS NOT NULL AND capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").alias("c")).orderBy("container_kind")
    rows = found.toLocalIterator()
    while part := [(r[0], int(r[1])) for r in itertools.islice(rows, KINDS)]:
        yield part


def pieces(measured: DataFrame, kinds: list[tuple[str, int]]) -> DataFrame:
    """What has to be placed, per kind, of ``doc_id, tokens``: whole texts, or full pieces and a rest."""
    options = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kinds])
    each = measured.select("doc_id", "tokens", F.explode(options).alias("k")).select("doc_id", "tokens", "k.*")
    last = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")) - 1, F.lit(0))
    cutup = each.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    first = F.col("piece") * F.col("capacity")
    return cutup.select("container_kind", "capacity", "doc_id", "piece", first.alias("first_token"), F.least(F.col("capacity"), F.col("tokens") - first).alias("tokens"))


def pack(documents: DataFrame, container_sizes: DataFrame, part_items: int = PART_ITEMS, measure: Measure = sizes) -> DataFrame:
    """``container_kind, capacity, container, doc_id, piece, first_token, tokens``."""
    spark = documents.sparkSession
    columns = ["container_kind", "capacity", "container", "doc_id", "piece", "first_token", "tokens"]
    measured = cut(measure(documents).select("doc_id", "tokens"))
    done = [_pack_kinds(pieces(measured, kinds), columns, part_items) for kinds in containers_of(container_sizes)]
    return reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], SCHEMA).select(*columns)


def _pack_kinds(placed: DataFrame, columns: list[str], part_items: int) -> DataFrame:
    full = placed.where("tokens = capacity").withColumn("container", F.concat_ws("-", "container_kind", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece").cast("string")))
    items = placed.where("tokens < capacity")

    def packed(df: DataFrame, salt: int, n: int) -> DataFrame:
        parts = max(1, math.ceil(n / part_items))
        part = F.pmod(F.xxhash64(F.lit(salt), "doc_id", "piece"), F.lit(parts)).cast("int")
        grouped = df.select("container_kind", "capacity", "doc_id", "piece", "first_token", "tokens", part.alias("part")).groupBy("container_kind", "part")
        return cut(grouped.applyInPandas(lambda p: _pack(p, str(salt)), SCHEMA))

    most = items.groupBy("container_kind").count().agg(F.max("count")).first()[0] or 0
    done, current = [full.select(*columns)], packed(items, 0, most)
    for salt in itertools.count(1):
        # every round but the last saves a container at least, so this ends
        loose = (F.col("gap") > 0) & (F.col("fullness") < F.greatest(F.lit(16), F.col("gap") * 8))
        released, kept = current.where(loose), current.where(~loose)
        before = {r[0]: (r[1], r[2]) for r in released.groupBy("container_kind").agg(F.countDistinct("container"), F.count("*")).collect()}
        if not before:
            break
        again = packed(released, salt, max(n for _, n in before.values()))
        after = {r[0]: r[1] for r in again.groupBy("container_kind").agg(F.countDistinct("container")).collect()}
        better = [k for k in before if after[k] < before[k][0]]
        done += [kept.select(*columns), released.where(~F.col("container_kind").isin(better)).select(*columns)]
        current = again.where(F.col("container_kind").isin(better))
        if not better:
            break
    done.append(current.select(*columns))
    return reduce(DataFrame.unionByName, done)


def report(documents: DataFrame, container_sizes: DataFrame, part_items: int = PART_ITEMS, measure: Measure = sizes) -> DataFrame:
    """Per kind: containers used, the lower bound over all documents, tokens and share of space used."""
    out = cut(pack(documents, container_sizes, part_items, measure))
    # a group holds at most a row per size, and there are no more sizes than the capacity
    histogram = out.groupBy("container_kind", "capacity", "tokens").agg(F.count("*").alias("n"))
    schema = "container_kind string, capacity bigint, pieces bigint, tokens bigint, lower_bound bigint"
    bounds = histogram.groupBy("container_kind").applyInPandas(_bound, schema)
    used = out.groupBy("container_kind").agg(F.countDistinct("container").alias("containers"))
    share = F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("used_share")
    return bounds.join(used, "container_kind").select("container_kind", "capacity", "pieces", "containers", "lower_bound", "tokens", share)


def _bound(sizes_of_kind: pd.DataFrame) -> pd.DataFrame:
    w, n, capacity = sizes_of_kind["tokens"].to_numpy(), sizes_of_kind["n"].to_numpy(), int(sizes_of_kind["capacity"].iloc[0])
    row = [sizes_of_kind["container_kind"].iloc[0], capacity, int(n.sum()), int((w * n).sum()), lower_bound(w, capacity, n)]
    return pd.DataFrame([row], columns=["container_kind", "capacity", "pieces", "tokens", "lower_bound"])
