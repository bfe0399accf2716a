"""Duplicates hidden by formatting differences.

Every record gets a canonical key; the keys are range-partitioned and sorted externally, and each
partition is scanned as a stream of adjacent runs whose full keys are compared. The record id is
the last part of the sort key, so even a group of copies that holds a third of all rows is spread
over partitions; runs that cross a partition's edge are stitched from one summary per partition.

Formatting is whitespace and invisible characters, letter case, punctuation and, in content made
of named fields (``key: value`` pieces or a JSON object), their order and notation. Sign and
decimal point of a number are content, as are word order and which value belongs to which field.

Defined results: a null content or id takes part in nothing; contents without any letter or digit
are equal to each other; null scopes are a scope of their own; several rows of one id with the
same content are one id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import PID, key_hash, partition_summaries, range_sorted

_NUMBER_OR_WORD = re.compile(r"(?P<minus>(?<![^\s(\[{:=,;|\"'])[-−﹣－](?=\d))?(?P<num>\d+(?:[.,]\d+)*)|(?P<word>[^\W\d_]+)")
_SEPARATOR = re.compile(r"[,;|\r\n•]")
_FIELD = re.compile(r"^[\s\"'{(\[<>#*\-“„«]*([^\W\d_][\w .\-]{0,39}?)[\s\"'”]*[:=](?!//)\s*(.*)$", re.S)


def _squash(text: str) -> str:
    """Letters and numbers in their order; a bar keeps two numbers apart, a word needs none."""
    out: list[str] = []
    number = False
    for m in _NUMBER_OR_WORD.finditer(text):
        if m["num"]:
            out.append(("|" if number else "") + ("-" if m["minus"] else "") + m["num"])
            number = True
        else:
            out.append(m["word"])
            number = False
    return "".join(out)


def _flat(value: object, path: str, out: list[tuple[str, str]]) -> None:
    if isinstance(value, list) and path == "" or isinstance(value, dict):
        items = value.items() if isinstance(value, dict) else enumerate(value)
        for k, v in items:
            _flat(v, f"{path}/{_squash(str(k))}", out)
    elif isinstance(value, list):
        out.append((path, "[" + ",".join(_squash(json.dumps(v, ensure_ascii=False)) for v in value) + "]"))
    else:
        out.append((path, "null" if value is None else _squash(str(value).lower() if isinstance(value, bool) else str(value))))


def _fields(text: str) -> list[tuple[str, str]] | None:
    """The named fields of ``text``, or None if it isn't made of them."""
    inner = text.strip(" \t\r\n.!?")
    if inner[:1] == "{" and inner[-1:] == "}":
        try:
            value = json.loads(inner, parse_int=str, parse_float=str, strict=False)
            out: list[tuple[str, str]] = []
            _flat(value, "", out)
            return out
        except (ValueError, RecursionError):
            pass
    pieces = [p for p in _SEPARATOR.split(text) if p.strip()]
    found: list[list[str]] = []
    for p in pieces:
        m = _FIELD.match(p)
        if m:
            found.append(["/" + _squash(m[1]), m[2]])
        elif found:
            found[-1][1] += " , " + p
        elif _squash(p):
            return None
    return [(k, _squash(v)) for k, v in found] if len(found) > 1 else None


def canonical(text: str) -> str:
    """The key under which contents that differ only in formatting are equal."""
    t = unicodedata.normalize("NFC", text)
    t = "".join(c for c in t if unicodedata.category(c) != "Cf") if not t.isascii() else t
    t = t.casefold()
    fields = _fields(t) if ":" in t or "=" in t else None
    if fields is not None:
        return "\x02" + "\x1e".join(f"{k}\x1f{v}" for k, v in sorted(fields))
    return _squash(t)


def _sorted_keys(memories: DataFrame) -> DataFrame:
    rows = memories.where("id IS NOT NULL AND content IS NOT NULL").select("id", "tenant_id", "namespace", "content")

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "tenant_id": b["tenant_id"], "namespace": b["namespace"], "canon": [canonical(t) for t in b["content"]]})

    keyed = rows.mapInPandas(keys, "id string, tenant_id string, namespace string, canon string")
    return range_sorted(keyed, ["tenant_id", "namespace", "canon", "id"], expensive=True)


def _runs(placed: DataFrame) -> tuple[DataFrame, dict[int, tuple]]:
    """The sorted rows with a hash of their key, and per partition what its first run continues."""
    hashed = placed.withColumn("kh", key_hash(["tenant_id", "namespace", "canon"]))

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for b in batches:
            if not len(b):
                continue
            if out is None:
                out = {"pid": int(b[PID].iloc[0]), "first": b["kh"].iloc[0], "last": b["kh"].iloc[0], "run_id": b["id"].iloc[0], "single": True}
            last = b["kh"].iloc[-1]
            if last != out["last"]:
                run = b["id"][b["kh"].eq(last)]
                out |= {"last": last, "run_id": run.iloc[0], "single": False}
            out["last_id"] = b["id"].iloc[-1]
        if out is not None:
            yield pd.DataFrame([out])

    edge = partition_summaries(
        hashed.select("id", "kh", PID), edges, "pid int, first string, last string, run_id string, single boolean, last_id string"
    )
    carry: dict[int, tuple] = {}
    open_key = open_id = last_id = None
    for e in edge:
        goes_on = e["first"] == open_key
        carry[e["pid"]] = (open_id, last_id) if goes_on else (None, None)
        open_id = open_id if goes_on and e["single"] else e["run_id"]
        open_key, last_id = e["last"], e["last_id"]
    return placed, carry


def _scan(placed: DataFrame, carry: dict[int, tuple], emit, schema: str) -> DataFrame:
    key_columns = ["tenant_id", "namespace", "canon"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = run_id = last_id = None
        fresh = True
        for b in batches:
            if not len(b):
                continue
            k = b[key_columns].fillna("\x00")
            if fresh:
                run_id, last_id = carry[int(b[PID].iloc[0])]
                key = tuple(k.iloc[0]) if run_id is not None else None
                fresh = False
            starts = k.ne(k.shift()).any(axis=1)
            starts.iloc[0] = tuple(k.iloc[0]) != key
            run = starts.cumsum()
            first = b["id"].where(starts).ffill()
            first = first.where(run.gt(0), run_id)
            before = b["id"].shift()
            before.iloc[0] = last_id
            repeated = b["id"].eq(before) & ~starts
            yield emit(b.assign(first_id=first, repeated=repeated, starts=starts))
            key, run_id, last_id = tuple(k.iloc[-1]), first.iloc[-1], b["id"].iloc[-1]

    return placed.mapInPandas(scan, schema)


def formatting_copies(memories: DataFrame) -> DataFrame:
    """``first_id, copy_id``: for each group of copies a row per id other than the smallest."""
    placed, carry = _runs(_sorted_keys(memories))

    def emit(b: pd.DataFrame) -> pd.DataFrame:
        b = b[~b["repeated"] & b["id"].ne(b["first_id"])]
        return b[["first_id", "id"]].rename(columns={"id": "copy_id"})

    return _scan(placed, carry, emit, "first_id string, copy_id string")


def collapse(memories: DataFrame) -> DataFrame:
    """One representative per group with exact counts: ``tenant_id, namespace, first_id, n_ids, n_rows``."""
    placed, carry = _runs(_sorted_keys(memories))

    def emit(b: pd.DataFrame) -> pd.DataFrame:
        g = b.assign(n_ids=(~b["repeated"]).astype("int64"), n_rows=1, run=b["starts"].cumsum()).groupby("run", sort=False)
        return g.agg({"tenant_id": lambda s: s.iloc[0], "namespace": lambda s: s.iloc[0], "kh": lambda s: s.iloc[0], "first_id": "first", "n_ids": "sum", "n_rows": "sum"})

    hashed = placed.withColumn("kh", key_hash(["tenant_id", "namespace", "canon"]))
    parts = _scan(hashed, carry, emit, "tenant_id string, namespace string, kh string, first_id string, n_ids bigint, n_rows bigint")
    # an id may stand for several groups (its content differs between rows), so groups are told apart by their key
    return parts.groupBy("tenant_id", "namespace", "kh", "first_id").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_rows").alias("n_rows")).drop("kh")
