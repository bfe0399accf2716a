"""One ranking from several differently scaled scores.

Within a scope every score is replaced by its rank (ties share the mean rank), so that ranges and
distributions no longer matter, and turned in the direction declared for it. The correlation matrix
of the ranks is summed up on the map side; its first principal component, turned as a whole so that
its loadings point in the declared directions on balance, gives the weights, and items are sorted by
their projection. A score that runs against the others within a scope keeps its negative loading;
``components`` tells the loadings and the share of the variance that the component explains.

A scope of any size is ranked without a one-task group: equal values are counted first, the
distinct values are laid out by range partitions, and running totals are stitched (``ordered``).
Ranks of values that many rows share are joined by broadcast (there can only be few such values),
so that a common value is no hot key.

Defined results: of several rows of one id the latest state counts (``records.latest``); times in
seconds or microseconds are read as such; a null, NaN or negative score says nothing and
counts as the scope's mean; null scopes are a scope of their own; scores that don't vary get no
weight; a component whose loadings add up to nothing has the first of them positive; equal
projections are ordered by id; rows without id don't count; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut
from ..operators.ordered import running_totals
from ..operators.records import latest

#: score columns and the direction in which each speaks for an item
DIRECTIONS = {"importance": 1, "access_count": 1, "last_accessed_at_ms": 1, "created_at_ms": 1}
COMMON = 5_000  #: a value is common if at least one in so many rows of the table has it: then there are no more than that of a score
SQUARINGS = 30


def _ms(column: str) -> Column:
    """Epoch milliseconds, whatever unit they were written in."""
    c = F.col(column).cast("double")
    return F.when(c < 1e11, c * 1000).when(c >= 1e14, c / 1000).otherwise(c)


def _scores(memories: DataFrame) -> DataFrame:
    names = list(DIRECTIONS)
    clean = [_ms(n) if n.endswith("_ms") else F.col(n).cast("double") for n in names]
    clean = [F.when((c >= 0) & ~F.isnan(c), c).alias(n) for c, n in zip(clean, names)]
    scope = [F.coalesce(F.col("tenant_id"), F.lit("\u0000")).alias("t"), F.coalesce(F.col("namespace"), F.lit("\u0000")).alias("ns")]
    return latest(memories, ["tenant_id", "namespace", *names]).select("id", *scope, *clean)


def principal(corr: np.ndarray) -> tuple[np.ndarray, float]:
    """The first principal component of a correlation matrix and the share of the variance that it explains.

    The matrix is squared again and again, so that only the greatest eigenvalue's part is left.
    """
    m = corr / max(np.trace(corr), 1e-300)
    for _ in range(SQUARINGS):
        m = m @ m
        m = m / np.trace(m)
    column = m[:, int(np.argmax(np.diag(m)))]
    load = column / np.sqrt(column @ column)
    total = load.sum()
    if total < -1e-9 or abs(total) <= 1e-9 and load[np.flatnonzero(np.abs(load) > 1e-9)[0]] < 0:
        load = -load
    return load, float(load @ corr @ load / np.trace(corr))


def first_component(moments: pd.DataFrame, k: int, directions: list[int]) -> pd.DataFrame:
    """Weights, means and deviations per scope from its sums of products, and the share explained."""
    out = []
    turn = np.array(directions, float)
    for m in moments.itertuples(index=False):
        n = m.n
        mean = np.array([getattr(m, f"s{i}") for i in range(k)]) / n
        second = np.array([[getattr(m, f"p{min(i, j)}_{max(i, j)}") for j in range(k)] for i in range(k)]) / n
        cov = second - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov), 0, None))
        live = sd > 1e-9
        safe = np.where(live, sd, 1.0)
        corr = np.where(np.outer(live, live), cov / np.outer(safe, safe), 0.0) * np.outer(turn, turn)
        load, share = principal(corr) if live.any() else (np.zeros(k), 0.0)
        out.append([m.t, m.ns, int(n), share, *(load * turn * live), *mean, *np.where(live, 1 / safe, 0.0)])
    cols = ["t", "ns", "n", "share", *[f"w{i}" for i in range(k)], *[f"m{i}" for i in range(k)], *[f"d{i}" for i in range(k)]]
    return pd.DataFrame(out, columns=cols)


def _ranks(memories: DataFrame) -> DataFrame:
    """``id, t, ns, u0 ...``: centred ranks of the scores, 0 where a score says nothing; written once."""
    names = list(DIRECTIONS)
    keys = ["t", "ns", "s", "v"]
    rows = cut(_scores(memories))
    entries = F.array(*[F.struct(F.lit(i).alias("s"), F.col(n).alias("v")) for i, n in enumerate(names)])
    long = rows.select("id", "t", "ns", F.explode(entries).alias("e")).select("id", "t", "ns", "e.s", "e.v")
    told = long.where("v IS NOT NULL")
    values = told.groupBy(*keys).agg(F.count("*").alias("n"))
    ranked = running_totals(values, ["t", "ns", "s"], [F.col("v")], "n", "upto")
    sizes = ranked.groupBy("t", "ns", "s").agg(F.sum("n").alias("total"))
    ranked = cut(ranked.join(sizes, ["t", "ns", "s"]).select(*keys, "n", ((F.col("upto") - F.col("n") / 2) / F.col("total") - 0.5).alias("u")))
    most = max((rows.count() // COMMON), 1)
    common = F.broadcast(ranked.where(F.col("n") > most).select(*keys, F.col("u").alias("known")))  # no more than COMMON of each score
    marked = told.join(common, keys, "left")
    found = marked.where("known IS NOT NULL").select("id", "t", "ns", "s", F.col("known").alias("u"))
    others = marked.where("known IS NULL").drop("known").join(ranked.where(F.col("n") <= most).select(*keys, "u"), keys).select("id", "t", "ns", "s", "u")
    silent = long.where("v IS NULL").select("id", "t", "ns", "s", F.lit(0.0).alias("u"))
    every = found.unionByName(others).unionByName(silent)
    return cut(every.groupBy("id", "t", "ns").agg(*[F.sum(F.when(F.col("s") == i, F.col("u")).otherwise(0.0)).alias(f"u{i}") for i in range(len(names))]))


def _weights(wide: DataFrame) -> DataFrame:
    k, directions = len(DIRECTIONS), list(DIRECTIONS.values())
    sums = [F.sum(f"u{i}").alias(f"s{i}") for i in range(k)]
    products = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    moments = wide.groupBy("t", "ns").agg(F.count("*").alias("n"), *sums, *products)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield first_component(b, k, directions)

    return moments.mapInPandas(weigh, "t string, ns string, n bigint, share double, " + ", ".join(f"{c}{i} double" for c in "wmd" for i in range(k)))


def fused_ranking(memories: DataFrame) -> DataFrame:
    """``tenant_id, namespace, id, score, position``: position 1 is the best of its scope."""
    wide = _ranks(memories)
    projection = sum((F.col(f"w{i}") * (F.col(f"u{i}") - F.col(f"m{i}")) * F.col(f"d{i}") for i in range(len(DIRECTIONS))), F.lit(0.0))
    scored = wide.join(_weights(wide), ["t", "ns"]).select("t", "ns", "id", (F.round(projection, 9) + F.lit(0.0)).alias("score"))
    placed = running_totals(scored, ["t", "ns"], [F.col("score").desc(), F.col("id")], None, "position")
    return placed.select(
        F.nullif("t", F.lit("\u0000")).alias("tenant_id"), F.nullif("ns", F.lit("\u0000")).alias("namespace"), "id", "score", F.col("position").cast("bigint").alias("position")
    )


def components(memories: DataFrame) -> DataFrame:
    """``tenant_id, namespace, items, explained`` and a loading per score, one row per scope."""
    loadings = [F.round(f"w{i}", 6).alias(n) for i, n in enumerate(DIRECTIONS)]
    scope = [F.nullif("t", F.lit("\u0000")).alias("tenant_id"), F.nullif("ns", F.lit("\u0000")).alias("namespace")]
    return _weights(_ranks(memories)).select(*scope, F.col("n").alias("items"), F.round("share", 6).alias("explained"), *loadings)
