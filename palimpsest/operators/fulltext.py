"""Full-text search: BM25 of phrases and terms, many queries at once.

A query is one phrase of all its tokens or any of its terms; any of them suffices, and the phrase
lifts the rank. Statistics come from all records that have a content, of all scopes and also deleted
ones, as long as they are in the table; matches only from live ones in the query's scope.

Nothing is kept: the tokens of the texts are the index. The phrases of the queries are sent to all
tasks in slices of bounded number, and their document frequencies come back. Then scopes are cut
into blocks of texts and of queries by their counted sizes; within a block inverted lists are built,
each query adds up its lists, and only its best rows leave the block. So a common term costs
its postings in one task's memory and never a row per query and text in a shuffle.

Defined results: a null content has no postings, one without tokens counts as a text of length 0; a
query without any letter or digit matches nothing; equal ranks (9 decimals) are ordered by id;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import EPSILON
from ..functions.text import query_phrases, tokens
from .durable import cut

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6  # fixed values
MOST_HITS = 300  #: a literal bound lets Spark cut each query's hits before the shuffle
SLICE = 100_000  #: phrases counted in one pass over the texts
BLOCK_ROWS = 20_000  #: texts, and queries, of a block


def vocabulary(docs: DataFrame) -> DataFrame:
    """``term, df, cf``: documents (``content``) with the term, and how often it occurs; one aggregation, combined on the map side."""
    sorted_terms = docs.where("content IS NOT NULL").select(F.array_sort(tokens(F.col("content"))).alias("terms"))
    # among a text's sorted terms the first of its kind counts the text
    first = F.transform("terms", lambda t, i: F.struct(t.alias("term"), F.when((i == 0) | (F.get("terms", i - 1) != t), 1).otherwise(0).alias("head")))
    return sorted_terms.select(F.explode(first).alias("t")).groupBy("t.term").agg(F.sum("t.head").alias("df"), F.count("*").alias("cf"))


class _Inverted:
    """Inverted lists with positions of the texts of a block, of the tokens that some query asks for."""

    def __init__(self, texts: pa.ChunkedArray, wanted: set[str]):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        flat = texts.flatten().to_pylist()
        self.lengths = np.diff(texts.offsets.to_numpy()) if len(texts) else np.zeros(0, np.int64)
        self.number = {t: i for i, t in enumerate(sorted(wanted))}
        # a gap behind each text keeps phrases from running into the next one
        codes = np.full(len(flat) + len(texts), -1, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths + 1)
        codes[np.arange(len(flat)) + np.repeat(np.arange(len(texts)), self.lengths)] = [self.number.get(t, -1) for t in flat]
        self.codes = np.append(codes, np.full(1, -1))
        order = np.argsort(codes, kind="stable")
        self.at = order[np.searchsorted(codes[order], 0) :]
        self.starts = np.searchsorted(codes[self.at], np.arange(len(self.number) + 1))
        self.known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def find(self, phrase: str) -> tuple[np.ndarray, np.ndarray]:
        """The texts that hold the phrase, and how often."""
        if phrase not in self.known:
            numbers = [self.number[t] for t in phrase.split(" ")]
            pos = self.at[self.starts[numbers[0]] : self.starts[numbers[0] + 1]]
            for j, n in enumerate(numbers[1:], 1):
                pos = pos[pos + j < len(self.codes)]
                pos = pos[self.codes[pos + j] == n]
            self.known[phrase] = np.unique(self.doc[pos], return_counts=True)
        return self.known[phrase]


def _frequencies(texts: DataFrame, phrases: list[str]) -> DataFrame:
    """``term, df`` of the given phrases over ``tokens`` arrays; each task sends a row per phrase at most."""
    sent = texts.sparkSession.sparkContext.broadcast(phrases)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [p.split(" ") for p in sent.value]
        wanted = {t for ts in split for t in ts}
        df = np.zeros(len(split), np.int64)
        single: dict[str, int] = {ts[0]: i for i, ts in enumerate(split) if len(ts) == 1}
        longer: dict[tuple[str, str], list[int]] = {}
        for i, ts in enumerate(split):
            if len(ts) > 1:
                longer.setdefault((ts[0], ts[1]), []).append(i)
        for b in batches:
            index = _Inverted(b.column("tokens"), wanted)
            v = max(len(index.number), 1)
            names = sorted(wanted)
            pairs = np.unique(index.doc[index.at] * v + index.codes[index.at])
            for code, n in zip(*np.unique(pairs % v, return_counts=True)):
                if names[code] in single:
                    df[single[names[code]]] += n
            # only phrases whose first two tokens stand side by side somewhere are looked for
            x, y = index.codes[:-1], index.codes[1:]
            beside = np.unique(x[(x >= 0) & (y >= 0)] * v + y[(x >= 0) & (y >= 0)])
            for code in beside:
                for i in longer.get((names[code // v], names[code % v]), ()):
                    df[i] += len(index.find(sent.value[i])[0])
        yield pa.RecordBatch.from_arrays([pa.array(sent.value, pa.string()), pa.array(df)], names=["term", "df"])

    return texts.select("tokens").mapInArrow(count, "term string, df bigint").where("df > 0").groupBy("term").agg(F.sum("df").alias("df"))


def _idf(df: float, n: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), IDF_FLOOR)


def _known(texts: DataFrame, q: DataFrame, n: int) -> tuple[dict[str, float] | None, DataFrame]:
    """The weights of all phrases of the queries, or, where they are more than a slice, the queries with ``terms`` that carry them."""
    phrases = q.select(F.explode("phrases").alias("term")).distinct()
    first = [r[0] for r in phrases.limit(SLICE + 1).collect()]
    if len(first) <= SLICE:
        return {r["term"]: _idf(r["df"], n) for r in _frequencies(texts, first).collect()}, q
    parts, df = -(-phrases.count() // SLICE) + 1, None
    for i in range(parts):
        part = _frequencies(texts, [r[0] for r in phrases.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect()])
        df = part if df is None else df.unionByName(part)
    idf = F.greatest(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(IDF_FLOOR))
    each = q.select("qid", F.explode("phrases").alias("term")).groupBy("qid", "term").agg(F.count("*").cast("double").alias("w"))
    terms = each.join(df, "term").groupBy("qid").agg(F.collect_list(F.struct("term", "w", idf.alias("idf"))).alias("terms"))
    return None, q.drop("terms").join(terms, "qid")


def _distances(queries: list, docs: list, which: np.ndarray, rows: np.ndarray) -> list[float | None]:
    """Cosine distances of the hits, null where either side has no usable vector or their lengths differ."""
    out: list[float | None] = [None] * len(rows)
    starts = np.flatnonzero(np.diff(which, prepend=-1))
    for lo, hi in zip(starts, np.append(starts[1:], len(rows))):
        q = queries[which[lo]]
        at = [i for i in range(lo, hi) if q is not None and docs[rows[i]] is not None and len(docs[rows[i]]) == len(q)]
        if at:
            v, a = np.array([docs[rows[i]] for i in at], float), np.array(q, float)
            d = np.round(1 - v @ a / np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)) * np.sqrt(a @ a), EPSILON), 9)
            for i, x in zip(at, d):
                out[i] = float(x) if np.isfinite(x) else None
    return out


def _score(avgdl: float, idf: dict[str, float] | None):
    def weighted(phrases: list[str], terms: list[dict] | None) -> list[tuple[str, float, float]]:
        if idf is None:
            return [(t["term"], t["w"], t["idf"]) for t in terms or ()]
        return [(p, float(w), idf[p]) for p, w in Counter(phrases).items() if p in idf]

    def best(key, docs: pa.Table, queries: pa.Table) -> pa.Table:
        docs = docs.sort_by("id")
        asked = [(k, weighted(p, t), m) for k, p, t, m in zip(*(queries[c].to_pylist() for c in ("k", "phrases", "terms", "asked")))]
        index = _Inverted(docs["tokens"], {t for _, terms, _ in asked for p, _, _ in terms for t in p.split(" ")}) if docs.num_rows and asked else None
        marks: dict[str, set[int]] = {}
        if index and any(m for *_, m in asked):
            wanted = {e for *_, m in asked for e in m or ()}
            for i, entries in enumerate(docs["entries"].to_pylist()):
                for e in entries or ():
                    if e in wanted:
                        marks.setdefault(e, set()).add(i)
        which, at, scores = [], [], []
        if index:
            norm = K1 * (1 - B + B * index.lengths / avgdl) if avgdl else np.full(docs.num_rows, K1)
            total = np.zeros(docs.num_rows)
            for i, (k, terms, m) in enumerate(asked):
                touched = []
                for phrase, w, rare in terms:
                    d, tf = index.find(phrase)
                    if len(d):
                        total[d] += w * rare * tf * (K1 + 1) / (tf + norm[d])
                        touched.append(d)
                if not touched:
                    continue
                d = np.unique(np.concatenate(touched))
                s = np.round(total[d], 9)
                total[d] = 0
                if m:
                    passing = set.intersection(*(marks.get(e, set()) for e in m))
                    ok = np.isin(d, np.fromiter(passing, np.int64, len(passing)))
                    d, s = d[ok], s[ok]
                order = np.lexsort((d, -s))[:k]  # texts are in the order of their ids
                which.append(np.full(len(order), i))
                at.append(d[order])
                scores.append(s[order])
        rows, which, scores = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((at, np.int64), (which, np.int64), (scores, float)))
        found = queries.select(["qid", "k"]).take(pa.array(which))
        near = _distances(queries["vec"].to_pylist(), docs["vec"].to_pylist(), which, rows)
        return pa.table({"qid": found["qid"], "id": docs["id"].take(pa.array(rows)), "k": found["k"], "bm25": pa.array(scores), "dist": pa.array(near, pa.float64())})

    return best


def search(queries: DataFrame, docs: DataFrame, most: int = MOST_HITS) -> DataFrame:
    """``qid, id, bm25, rank, dist``: per query (``qid, tenant_id, namespace, text, k``) its k best records, k at most ``most``.

    If queries have ``asked`` (an array, null for no wish) and records ``entries``, only records with
    all entries asked for are ranked. If both have ``vec``, ``dist`` is their cosine distance.
    """
    for c, kind in (("entries", "array<string>"), ("vec", "array<float>")):
        docs = docs if c in docs.columns else docs.withColumn(c, F.lit(None).cast(kind))
    for c, kind in (("asked", "array<string>"), ("vec", "array<float>")):
        queries = queries if c in queries.columns else queries.withColumn(c, F.lit(None).cast(kind))
    texts = docs.where("content IS NOT NULL").select("id", "tenant_id", "namespace", "live", "entries", "vec", tokens(F.col("content")).alias("tokens"))
    scope = ["tenant_id", "namespace"]
    asked = queries.where("qid IS NOT NULL AND text IS NOT NULL AND k > 0").dropDuplicates(["qid"])
    weights = F.lit(None).cast("array<struct<term:string,w:double,idf:double>>").alias("terms")
    q = cut(asked.select(*scope, "qid", F.least(F.col("k"), F.lit(most)).cast("int").alias("k"), "asked", "vec", query_phrases(F.col("text")).alias("phrases"), weights))
    scopes = cut(texts.groupBy(*scope).agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("length"), F.ceil(F.count_if("live") / BLOCK_ROWS).cast("int").alias("db")))
    whole = scopes.agg(F.sum("n").alias("n"), F.sum("length").alias("length")).first()
    idf, q = _known(texts, q, whole["n"] or 0)
    sizes = scopes.where("db > 0").select(*scope, "db").join(q.groupBy(*scope).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("qb")), scope)
    d = texts.where("live").join(sizes, scope).select(*scope, "id", "tokens", "entries", "vec", F.pmod(F.xxhash64("id"), F.col("db")).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("c"))
    q = q.join(sizes, scope).select(*scope, "qid", "k", "phrases", "terms", "asked", "vec", F.pmod(F.xxhash64("qid"), F.col("qb")).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.col("db") - 1)).alias("b"))
    qid_type, id_type = (t.simpleString() for t in (queries.schema["qid"].dataType, docs.schema["id"].dataType))
    score = _score((whole["length"] or 0) / max(whole["n"] or 0, 1), idf)
    found = d.groupBy(*scope, "b", "c").cogroup(q.groupBy(*scope, "b", "c")).applyInArrow(score, f"qid {qid_type}, id {id_type}, k int, bm25 double, dist double")
    order = Window.partitionBy("qid").orderBy(F.col("bm25").desc(), "id")  # at most k rows per block
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {most}").where("rank <= k").select("qid", "id", "bm25", "rank", "dist")
