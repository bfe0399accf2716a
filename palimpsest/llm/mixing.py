"""Mixing sources to target weights by systematic sampling.

Each source's documents get the same expected number of copies, chosen so that the source reaches
its share of the mixture's tokens. Laid out by size, each document is emitted once per integer
that its stretch of the running sum of expected copies crosses, after one random offset per
source; ordering by size spreads the copies evenly over short and long texts, so the shares come
out near the targets.

The mixture is as large as the documents of its sources together, unless another size is asked for.
A source that is too small for its share of that is repeated up to its cap and no further; nothing
else is taken in its place, and the shares reached are reported as they are.

Running sums come from range partitions (``ordered``), so one source may hold any part of the rows;
the plan is a table too, so there may be any number of sources.

Defined results: sources without a target or with a null or non-positive share, and documents with
a null source, a null or blank text don't take part; targets of sources without documents are left
out and the other shares scaled up; several targets of a source count as the greatest share with
the smallest cap; a null cap means 1; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.durable import cut
from ..operators.ordered import running_totals
from .tokens import sizes

SEED = 11
Measure = Callable[[DataFrame], DataFrame]  #: gives ``doc_id, source, tokens`` of the documents


def in_characters(documents: DataFrame) -> DataFrame:
    """Sizes in characters, where no tokenizer is wanted."""
    return documents.where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", F.char_length("text").cast("bigint").alias("tokens"))


def _offset() -> F.Column:
    """A random number from 0 to 1 that hangs on the seed and the source only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED} "), F.col("source"))), 1, 8), 16, 10).cast("double") / 2.0**32


def _plan(tokens: DataFrame, mix_targets: DataFrame, total_tokens: float | None) -> DataFrame:
    """``source, goal, max_repeats, copies, offset`` of the sources that take part."""
    targets = (
        mix_targets.where("source IS NOT NULL AND target_share > 0 AND NOT isnan(target_share) AND coalesce(max_repeats, 1) > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("goal"), F.min(F.coalesce("max_repeats", F.lit(1))).cast("int").alias("max_repeats"))
    )
    rows = cut(targets.join(tokens.groupBy("source").agg(F.sum("tokens").alias("source_tokens")), "source"))
    whole = rows.agg(F.coalesce(F.sum("goal"), F.lit(1.0)).alias("goals"), F.coalesce(F.sum("source_tokens"), F.lit(0)).alias("tokens")).first()
    total = float(whole["tokens"]) if total_tokens is None else float(total_tokens)
    goal = F.col("goal") / F.lit(whole["goals"])
    copies = F.least(F.col("max_repeats").cast("double"), F.lit(total) * goal / F.col("source_tokens"))
    return rows.select("source", goal.alias("goal"), "max_repeats", copies.alias("copies"), _offset().alias("offset"))


def _mixture(documents: DataFrame, mix_targets: DataFrame, total_tokens: float | None, measure: Measure) -> tuple[DataFrame, DataFrame]:
    tokens = cut(measure(documents).where("source IS NOT NULL AND tokens > 0"))
    plan = _plan(tokens, mix_targets, total_tokens)
    chosen = tokens.join(plan.select("source", "copies", "offset", "max_repeats"), "source")
    placed = running_totals(chosen, ["source"], [F.col("tokens"), F.col("doc_id")], None, "at")
    crossed = F.floor(F.col("at") * F.col("copies") + F.col("offset")) - F.floor((F.col("at") - 1) * F.col("copies") + F.col("offset"))
    mixture = placed.withColumn("n", F.least(crossed.cast("int"), F.col("max_repeats"))).where("n > 0")
    return mixture.select("source", "doc_id", "tokens", F.col("n").alias("copies")), plan


def mixture(documents: DataFrame, mix_targets: DataFrame, total_tokens: float | None = None, measure: Measure = sizes) -> DataFrame:
    """``source, doc_id, tokens, copies``: the documents taken and how often each."""
    return _mixture(documents, mix_targets, total_tokens, measure)[0]


def shares(documents: DataFrame, mix_targets: DataFrame, total_tokens: float | None = None, measure: Measure = sizes) -> DataFrame:
    """``source, target_share, reached_share, tokens, docs, most_copies, max_repeats``, one row per source taking part."""
    mixed, plan = _mixture(documents, mix_targets, total_tokens, measure)
    per = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("docs"), F.max("copies").alias("most_copies"))
    per = cut(plan.select("source", F.col("goal").alias("target_share"), "max_repeats").join(per, "source", "left").na.fill(0, ["tokens", "docs", "most_copies"]))
    whole = max(per.agg(F.sum("tokens")).first()[0] or 0, 1)
    reached = F.round(F.col("tokens") / F.lit(whole), 6).alias("reached_share")
    return per.select("source", F.round("target_share", 6).alias("target_share"), reached, "tokens", "docs", "most_copies", "max_repeats")
