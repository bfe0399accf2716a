import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from palimpsest.functions import text
from palimpsest.operators import context, fulltext, recall, records

from .frames import memories

REQUEST = (
    "request_id string, tenant_id string, namespace string, agent_id string, user_id string, query_embedding array<float>, query_text string, max_items int, kinds array<string>, "
    "min_importance double, metadata_eq_json string, include_explanations boolean, mmr_lambda double, asked_at_ms bigint, rank int, id string"
)
NOW = 1_700_000_000_000


def requests(spark, rows):
    base = {"tenant_id": "t", "namespace": "n", "query_embedding": [1.0, 0.0, 0.0], "max_items": 5, "asked_at_ms": NOW}
    names = [c.split()[0] for c in REQUEST.split(", ")]
    return spark.createDataFrame([tuple((base | {"request_id": f"q{i}"} | r).get(n) for n in names) for i, r in enumerate(rows)], REQUEST)


def test_hybrid_candidates(spark):
    m = memories(spark, [
        {"id": "A", "content": "tide table", "embedding": [0.6, 0.8, 0.0]},
        {"id": "B", "content": "the harbour pilot", "embedding": [0.0, 0.0, -2.0]},
        {"id": "C", "content": "harbour", "embedding": [0.6, 0.8, 0.0], "tenant_id": "other"},
        {"id": "D", "content": "harbour", "embedding": None, "status": "deleted"},
        {"id": "E", "content": None, "embedding": [float("nan"), 0.0, 0.0]},
    ])
    r = recall.valid_requests(requests(spark, [{"query_text": "harbour", "max_items": 1, "query_embedding": [3.0, 4.0, 0.0]}]))
    s = {x["id"]: x for x in recall.scored(r, recall.prepared(m), recall.candidates(r, recall.prepared(m))).collect()}
    assert set(s) == {"A", "B"}
    assert s["A"]["similarity"] == pytest.approx(1.0) and "fts5_lexical_candidate" not in s["A"]["notes"]
    assert "fts5_lexical_candidate" in s["B"]["notes"]
    assert s["A"]["score"] == pytest.approx(0.7 + 0.15 * 0.5 + 0.1, abs=1e-8)


def test_mmr(spark):
    # two near-copies above a third record in another direction
    m = memories(spark, [
        {"id": "kiln", "content": "kiln log, monday", "embedding": [0.0, 4.0, 0.3], "importance": 0.7},
        {"id": "kiln again", "content": "kiln log, tuesday", "embedding": [0.1, 4.0, 0.3], "importance": 0.6},
        {"id": "glaze", "content": "glaze recipe", "embedding": [3.0, 2.5, 0.0], "importance": 0.6},
    ])
    ask = {"query_embedding": [0.0, 2.0, 0.1], "max_items": 2}
    got = recall.recall(requests(spark, [ask | {"mmr_lambda": 0.4}, ask]), m).orderBy("qid", "position").collect()
    assert [(r["qid"], r["id"], r["returned"]) for r in got] == [("q0", "kiln", 2), ("q0", "glaze", 2), ("q1", "kiln", 2), ("q1", "kiln again", 2)]


def test_filters(spark):
    m = memories(spark, [
        {"id": "a", "embedding": [1.0, 0.0, 0.0], "metadata_json": '{"p": "1", "x": true}', "kind": "FACT "},
        {"id": "b", "embedding": [1.0, 0.0, 0.0], "metadata_json": '{"p": 1}', "kind": "episodic", "importance": 0.1},
        {"id": "c", "embedding": [1.0, 0.0, 0.0], "metadata_json": '{"p', "importance": None, "agent_id": "g"},
        {"id": "d", "embedding": [1.0, 0.0, 0.0], "expires_at_ms": NOW},
        {"id": "e", "embedding": [1.0, 0.0, 0.0], "status": " Deleted"},
        {"id": "f", "embedding": [1.0, 0.0], "embedding_dims": 3},
    ])
    q = requests(spark, [{}, {"metadata_eq_json": '{"p": "1"}'}, {"metadata_eq_json": '{"p": 1}'}, {"metadata_eq_json": "{}"}, {"kinds": ["episodic"]}, {"min_importance": 0.2}, {"metadata_eq_json": "broken"}, {"agent_id": "g"}])
    r = recall.valid_requests(q)

    def by(scores):
        out = {}
        for x in scores.collect():
            out.setdefault(x["qid"], set()).add(x["id"])
        return out

    m = recall.prepared(m)
    pool = recall.candidates(r, m)
    got = by(recall.scored(r, m, pool))
    assert got == {"q0": {"a", "b", "c"}, "q1": {"a"}, "q2": {"b"}, "q3": {"a", "b", "c"}, "q4": {"b"}, "q5": {"a"}, "q7": {"a", "b", "c"}}
    assert by(recall.scored(r, m, pool, by_agent=True))["q7"] == {"c"}


def test_metadata_before_the_text_cut(spark):
    near = [{"id": f"a{i}", "content": "word", "embedding": [1.0, 0.0, 0.0], "metadata_json": '{"p": "2"}'} for i in range(5)]
    far = [{"id": f"b{i}", "content": "word and more", "embedding": [0.0, 0.0, 1.0], "metadata_json": m} for i, m in enumerate(['{"p": "1", "x": 2}', '{"p": 1}', None])]
    q = requests(spark, [{"query_text": "word", "max_items": 1, "metadata_eq_json": m} for m in ('{"p": "1"}', '{"p": 1}', "{}", "broken", None)])
    r, m = recall.valid_requests(q), recall.prepared(memories(spark, near + far))
    pool = recall.candidates(r, m)
    text = {}
    for x in pool.where("trank IS NOT NULL").orderBy("trank").collect():
        text.setdefault(x["qid"], []).append(x["id"])
    assert text == {"q0": ["b0"], "q1": ["b1"], "q2": ["a0", "a1", "a2"], "q4": ["a0", "a1", "a2"]}
    got = {(x["qid"], x["id"]): x["notes"] for x in recall.scored(r, m, pool).collect()}
    assert [k for k in sorted(got) if k[0] in ("q0", "q1")] == [("q0", "b0"), ("q1", "b1")] and "fts5_lexical_candidate" in got["q0", "b0"]


def test_store_passes_its_recall_limit(spark, tmp_path, monkeypatch):
    from palimpsest.store import MemoryStore

    rows = [{"id": f"{i:03d}", "content": "word", "embedding": [1.0, i / 400, 0.0]} for i in range(400)]
    q = requests(spark, [{"query_text": "word", "max_items": 380}])
    store = MemoryStore(spark, str(tmp_path / "s"), 3, "m", max_recall_limit=200)
    monkeypatch.setattr(store, "records", lambda: memories(spark, rows))
    assert store.recall_batch(q).count() == 380


def test_invalid_requests_and_empty_tables(spark):
    q = requests(spark, [{}, {"tenant_id": " "}, {"namespace": None}, {"max_items": 0}, {"query_embedding": [1.0]}, {"mmr_lambda": 2.0}, {"request_id": None}, {"query_embedding": None}])
    bad = {r["request_id"]: r["reason"] for r in recall.invalid_requests(q, 3).collect()}
    assert bad == {"q1": "tenant_id", "q2": "namespace", "q3": "max_items", "q4": "query_embedding", "q5": "mmr_lambda", None: "request_id", "q7": "query_embedding"}
    assert recall.recall(q, memories(spark, []), 3).count() == 0
    assert recall.recall(q.limit(0), memories(spark, [{"id": "a", "embedding": [1.0, 0.0, 0.0]}]), 3).count() == 0


def test_scope_isolation(spark):
    rows = [{"id": f"{t}{n}{i}", "tenant_id": f"t{t}", "namespace": f"n{n}", "content": "shared word", "embedding": [1.0, float(i), 0.0]} for t in range(3) for n in range(2) for i in range(4)]
    q = requests(spark, [{"tenant_id": f"t{t}", "namespace": f"n{n}", "query_text": "word", "request_id": f"{t}{n}"} for t in range(3) for n in range(2)])
    got = recall.recall(q, memories(spark, rows)).collect()
    assert len(got) == 24 and all(r["id"].startswith(r["qid"]) for r in got)


def test_hostile_text(spark):
    m = memories(spark, [{"id": "a", "content": "it's a ledger", "embedding": [1.0, 0.0, 0.0]}])
    hostile = ["''", "; drop it", "x NOT y", "or OR or", "^~", "\x00\x01", "z" * 6000, "))))", "col:umn", "-", "_-_"]
    assert recall.recall(requests(spark, [{"query_text": t} for t in hostile]), m).count() == len(hostile)
    assert text.sanitize('take "that" for_it-then') == ["take", "that", "for_it-then"]
    assert text.match_expression("a b") == '"a b" OR "a" OR "b"' and text.match_expression("!?") == ""


def test_bm25(spark):
    m = memories(spark, [{"id": "a", "content": "Copper lantern"}, {"id": "b", "content": "copper copper wire"}, {"id": "c", "content": None}, {"id": "d", "content": ""}, {"id": "e", "content": "copper", "status": "deleted"}])
    docs = records.latest(m, ["tenant_id", "namespace", "content", "status"]).withColumn("live", F.col("status") == "active")
    q = spark.createDataFrame([("q", "t", "n", "copper", 5), ("r", "t", "n", "!!", 5), ("s", "t", "n", None, 5)], "qid string, tenant_id string, namespace string, text string, k int")
    assert [r["id"] for r in fulltext.search(q, docs).orderBy("rank").collect()] == ["b", "a"]
    assert fulltext.search(q, docs.limit(0)).count() == 0
    assert fulltext.search(q.limit(0), docs).count() == 0


def test_accents_and_phrases_of_queries(spark):
    one = spark.createDataFrame([("Café-au_lait  CRÈME e\u0301!",), ("solo",), ("--",), (None,)], "t string")
    assert [r["p"] for r in one.select(text.query_phrases(F.col("t")).alias("p")).collect()] == [["cafe au lait creme e", "cafe au lait", "creme", "e"], ["solo", "solo"], [], None]
    assert one.select(text.tokens(F.lit("Ñandú Größe e\u0301té йод")).alias("x")).first()["x"] == ["nandu", "große", "ete", "йод"]


def brute_search(docs, queries, k1=1.2, b=0.75):
    import math

    lengths = {i: len(ts) for i, _, _, ts, _ in docs}
    n, avg = len(docs), sum(lengths.values()) / max(len(docs), 1)

    def tf(ts, p):
        return sum(ts[i : i + len(p)] == p for i in range(len(ts) - len(p) + 1))

    out = {}
    for q, scope, words, k, asked in queries:
        phrases = [words, *[[w] for w in words]]
        score = {}
        for p in phrases:
            df = sum(tf(ts, p) > 0 for _, _, _, ts, _ in docs)
            for i, s, live, ts, entries in docs:
                f = tf(ts, p)
                if f and live and s == scope:
                    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                    score[i] = score.get(i, 0) + idf * f * (k1 + 1) / (f + k1 * (1 - b + b * lengths[i] / avg))
        kept = [(-round(v, 9), i) for i, v in score.items() if asked is None or set(asked) <= set(next(d[4] for d in docs if d[0] == i))]
        out |= {(q, i): r for r, (_, i) in enumerate(sorted(kept)[:k], 1)}
    return out


@pytest.mark.parametrize("block,slice_", [(20_000, 100_000), (7, 5)])
def test_search_matches_brute_force(spark, monkeypatch, block, slice_):
    import random

    monkeypatch.setattr(fulltext, "BLOCK_ROWS", block)
    monkeypatch.setattr(fulltext, "SLICE", slice_)
    rng = random.Random(4)
    words = ["oak", "elm", "ash", "fir", "yew"]
    docs = [(f"d{i:02d}", rng.choice("xy"), rng.random() < 0.8, rng.choices(words, k=rng.randrange(0, 9)), rng.sample(["m1", "m2"], rng.randrange(3))) for i in range(60)]
    queries = [(f"q{i}", rng.choice("xy"), rng.choices(words, k=rng.randrange(1, 4)), rng.choice([3, 50]), rng.choice([None, None, [], ["m1"], ["m1", "m2"]])) for i in range(30)]
    d = spark.createDataFrame([(i, s, "n", live, ", ".join(ts), e, 9) for i, s, live, ts, e in docs], "id string, tenant_id string, namespace string, live boolean, content string, entries array<string>, df int")
    q = spark.createDataFrame([(i, s, "n", " ".join(ws), k, a, 1.5) for i, s, ws, k, a in queries], "qid string, tenant_id string, namespace string, text string, k int, asked array<string>, term double")
    got = {(r["qid"], r["id"]): r["rank"] for r in fulltext.search(q, d).collect()}
    assert got == brute_search(docs, queries)


def test_rrf(spark):
    dense = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "qid string, id string, vrank int")
    lex = spark.createDataFrame([("q", "b", 1), ("q", "c", 2)], "qid string, id string, trank int")
    got = {r["id"]: r["rrf"] for r in recall.fuse(dense, lex).collect()}
    assert got == pytest.approx({"a": 1 / 61, "b": 1 / 62 + 1 / 61, "c": 1 / 62})


def test_context(spark):
    rows = spark.createDataFrame([("q", 1, "fact", "x" * 40, 0.735), ("q", 2, "fact", "y" * 4000, 0.5), ("q", 3, "fact", "z", 0.4), ("r", 1, "fact", None, 0.1)], "qid string, position int, kind string, content string, score double")
    lines = context.lines(rows, 100).orderBy("qid", "position").collect()
    assert [(r["qid"], r["position"]) for r in lines] == [("q", 1), ("r", 1)]  # stops at the first that doesn't fit
    out = {r["qid"]: r for r in context.contexts(rows, 100, "* [{kind}] {content} (relevance: {score:.2})", footer="end").collect()}
    assert out["q"]["context"].startswith(context.HEADER + "\n* [fact] xxxx") and out["q"]["context"].endswith("\nend") and out["q"]["tokens"] <= 100
    assert context.contexts(rows, 1, header=None).where("tokens > 1").count() == 0
    with pytest.raises(ValueError):
        context.lines(rows, 0)


def test_scalars(spark):
    one = spark.createDataFrame([("é", '{"a": 1, "b": "1"}'), ("", "x"), (None, None)], "s string, j string")
    assert [r["x"] for r in one.select(S.token_estimate(F.col("s")).alias("x")).collect()] == [1, 0, None]
    entries = [r["x"] for r in one.select(S.json_entries("j").alias("x")).collect()]
    assert entries == [["a\x1f1", 'b\x1f"1"'], None, None]
    m = spark.range(1).select(F.create_map(F.lit("a"), F.lit("1")).alias("m"))
    assert m.select(S.patch_map(F.col("m"), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))).alias("x")).first()["x"] == {"a": "2", "b": "3"}
    assert m.select(S.patch_map(F.lit(None).cast("map<string,string>"), F.col("m")).alias("x")).first()["x"] == {"a": "1"}


def test_records(spark):
    m = memories(spark, [
        {"id": "a", "revision": 1, "status": "active"}, {"id": "a", "revision": 2, "status": "DELETED"}, {"id": "b", "expires_at_ms": 5}, {"id": "c", "status": None, "kind": "odd"},
        {"id": None}, {"id": "d", "embedding": [1.0], "embedding_dims": 2},
    ])
    v = records.latest(m, ["status", "kind", "expires_at_ms", "updated_at_ms", "embedding", "embedding_dims"])
    got = {r["id"]: (r["status"], r["kind"]) for r in v.collect()}
    assert got == {"a": ("deleted", "fact"), "b": ("active", "fact"), "c": ("pending", "episodic"), "d": ("active", "fact")}
    assert {r["id"] for r in records.purgeable(v, 10).collect()} == {"a", "b"}
    assert records.vacuum_batch(v, 10, 0).count() == 0 and records.vacuumed(v, 10, 1).count() == 3
    with pytest.raises(ValueError):
        records.in_scope("", "n")
