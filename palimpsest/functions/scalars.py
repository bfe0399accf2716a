"""Scalar expressions of recall, context formatting and the record store."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# fixed values: weights of the score and its time scale
WEIGHTS = {"similarity": 0.70, "importance": 0.15, "recency": 0.10, "reinforcement": 0.05}
RECENCY_MS = 604_800_000.0
RRF_K = 60


def clamp01(c: Column) -> Column:
    """``c`` within 0 and 1; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def similarity(cosine: Column) -> Column:
    """1 for a cosine distance of 0, 0 for one of 2; a missing distance counts as 1."""
    return clamp01(1.0 - F.coalesce(cosine, F.lit(1.0)) / 2.0)


def recency(created_ms: Column, now_ms: Column) -> Column:
    age = F.greatest(now_ms - created_ms, F.lit(0)).cast("double")
    return F.coalesce(F.exp(-age / RECENCY_MS), F.lit(0.0))


def reinforcement(access_count: Column) -> Column:
    return clamp01(F.coalesce(access_count, F.lit(0)).cast("double") / 10.0)


def total_score(sim: Column, imp: Column, rec: Column, reinf: Column) -> Column:
    w = WEIGHTS
    return w["similarity"] * sim + w["importance"] * imp + w["recency"] * rec + w["reinforcement"] * reinf


def trimmed_lower(c: Column) -> Column:
    return F.lower(F.btrim(c, F.lit(" \t\r\n")))


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4.0)).cast("int")


def render(template: str, kind: Column, content: Column, score: Column) -> Column:
    """Fill ``{kind}``, ``{content}``, ``{score:.2}`` and ``{score}``, in this order, literally."""
    out = F.lit(template)
    for mark, value in (("{kind}", kind), ("{content}", content), ("{score:.2}", F.format_string("%.2f", score)), ("{score}", F.format_string("%.4f", score))):
        out = F.replace(out, F.lit(mark), value)
    return out


@pandas_udf(T.ArrayType(T.StringType()))
def json_entries(texts: pd.Series) -> pd.Series:
    """Top-level entries of a JSON object, each as key and JSON text of the value; null if it isn't one."""
    import json

    def entries(t):
        if t is None:
            return None
        try:
            value = json.loads(t)
        except ValueError:
            return None
        if not isinstance(value, dict):
            return None
        return [f"{k}\u001f{json.dumps(v, sort_keys=True, ensure_ascii=False)}" for k, v in value.items()]

    return texts.map(entries)


def patch_map(base: Column, patch: Column) -> Column:
    """Shallow merge of two maps: the patch wins, nothing is deleted, a null side counts as empty."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce(base, none), F.coalesce(patch, none)
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(y, x))
