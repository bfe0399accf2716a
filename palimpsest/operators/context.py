"""Context formatting: recalled records as lines within a token budget.

Lines are taken in order until the first that would exceed the budget; as the running total only
grows, a prefix sum and a filter are the same as stopping there. Line breaks don't count, except
the one after the header. The footer comes only if it still fits.

Defined results: a null content is an empty one; an empty header or footer is none; a budget below
1 is an error; requests without lines still get their header and footer if asked for by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import render, token_estimate

# fixed values: defaults
TEMPLATE = "- [{kind}] {content} (score: {score:.2})"
HEADER = "### Relevant Agent Memories:"
MAX_TOKENS = 1500


def _estimate(text: str) -> int:
    return -(-len(text.encode()) // 4)


def lines(recalled: DataFrame, max_tokens: int = MAX_TOKENS, template: str = TEMPLATE, header: str | None = HEADER) -> DataFrame:
    """``qid, position, line, tokens, used``: the lines of ``qid, position, kind, content, score`` that fit."""
    if max_tokens < 1:
        raise ValueError("max_tokens must be greater than 0")
    start = _estimate(header + "\n") if header else 0
    line = render(template, F.col("kind"), F.coalesce(F.col("content"), F.lit("")), F.col("score"))
    rows = recalled.withColumn("line", line).withColumn("tokens", token_estimate(F.col("line")))
    running = Window.partitionBy("qid").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("used", (F.sum("tokens").over(running) + start).cast("int")).where(F.col("used") <= max_tokens).select("qid", "position", "line", "tokens", "used")


def contexts(recalled: DataFrame, max_tokens: int = MAX_TOKENS, template: str = TEMPLATE, header: str | None = HEADER, footer: str | None = None) -> DataFrame:
    """``qid, context, tokens``: one text per request; a request has at most its limit of lines."""
    start = _estimate(header + "\n") if header else 0
    fit = lines(recalled, max_tokens, template, header)
    per = fit.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"), F.max("used").alias("used"))
    per = recalled.select("qid").distinct().join(per, "qid", "left").withColumn("used", F.coalesce("used", F.lit(start)))
    body = F.concat_ws("", F.transform("l", lambda x: F.concat(x["line"], F.lit("\n"))))
    text = F.concat(F.lit(header + "\n" if header else ""), body)
    if footer:
        cost = _estimate(footer)
        fits = F.col("used") + cost <= max_tokens
        return per.select("qid", F.when(fits, F.concat(text, F.lit(footer))).otherwise(text).alias("context"), F.when(fits, F.col("used") + cost).otherwise(F.col("used")).alias("tokens"))
    return per.select("qid", text.alias("context"), F.col("used").alias("tokens"))
