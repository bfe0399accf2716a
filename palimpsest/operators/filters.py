"""Boolean predicates over multi-valued metadata (``map<string, array<string>>``).

A missing key matches nothing; And, Or and In without operands match nothing; Not complements
within the rows that have any metadata. Every predicate is true or false, never null, so that
Catalyst can push it below joins and top-k.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Filter:
    def column(self, metadata: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Equals(Filter):
    field: str
    value: str

    def column(self, metadata: Column) -> Column:
        return F.coalesce(F.array_contains(metadata[self.field], self.value), F.lit(False))


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: tuple[str, ...]

    def column(self, metadata: Column) -> Column:
        if not self.values:
            return F.lit(False)
        return F.coalesce(F.arrays_overlap(metadata[self.field], F.array(*[F.lit(v) for v in self.values])), F.lit(False))


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...]

    def column(self, metadata: Column) -> Column:
        return reduce(and_, [p.column(metadata) for p in self.parts]) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...]

    def column(self, metadata: Column) -> Column:
        return reduce(or_, [p.column(metadata) for p in self.parts]) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    part: Filter

    def column(self, metadata: Column) -> Column:
        return has_metadata(metadata) & ~self.part.column(metadata)


def has_metadata(metadata: Column) -> Column:
    return F.coalesce(F.size(metadata) > 0, F.lit(False))


def from_dict(spec: dict | None) -> Filter | None:
    """``{field: value or list of values}``; several fields must all match; nothing given is no filter."""
    if not spec:
        return None
    parts: list[Filter] = []
    for field, value in spec.items():
        if isinstance(value, str):
            parts.append(Equals(field, value))
        elif isinstance(value, (list, tuple)) and all(isinstance(v, str) for v in value):
            parts.append(In(field, tuple(value)))
        else:
            raise TypeError(f"filter on {field!r} must be a string or a list of strings")
    return parts[0] if len(parts) == 1 else And(tuple(parts))


def selectivity(df: DataFrame, where: Filter, metadata: str = "metadata") -> DataFrame:
    """``matched, total, selectivity`` over the rows with metadata; 1.0 if there are none."""
    m = F.col(metadata)
    hit = F.sum(F.when(has_metadata(m) & where.column(m), 1).otherwise(0)).alias("matched")
    total = F.sum(F.when(has_metadata(m), 1).otherwise(0)).alias("total")
    sums = df.agg(F.coalesce(hit, F.lit(0)).alias("matched"), F.coalesce(total, F.lit(0)).alias("total"))
    return sums.withColumn("selectivity", F.when(F.col("total") == 0, 1.0).otherwise(F.col("matched") / F.col("total")))
