import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import metrics
from palimpsest.index import Index
from palimpsest.operators import filters, ivf, knn
from palimpsest.operators.filters import And, Equals, In, Not, Or


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_metrics(spark):
    assert value(spark, metrics.l2_squared(arr(1, 2, 3), arr(4, 5, 6))) == 27
    assert abs(value(spark, metrics.cosine_distance(arr(1, 2, 3), arr(1, 2, 3)))) < 1e-12
    assert value(spark, metrics.cosine_distance(arr(1, 0), arr(0, 1))) == 1
    assert value(spark, metrics.cosine_distance(arr(0, 0), arr(0, 1))) == 1
    assert value(spark, metrics.negated_dot(arr(1, 2), arr(3, 4))) == -11
    assert value(spark, metrics.l2_squared(arr(1, 2, 9), arr(1, 2))) == 0
    assert value(spark, metrics.l2_squared(F.lit(None).cast("array<double>"), arr(1))) is None
    with pytest.raises(ValueError):
        metrics.distance("hamming", arr(1), arr(1))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id bigint, vec array<float>")


def test_nearest_ties_short_tables_and_bad_vectors(spark):
    v = vectors(spark, [(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0]), (4, None), (5, [float("nan"), 0.0]), (6, [float("inf"), 0.0])])
    assert [r["id"] for r in knn.nearest(v, [0.0, 0.0], 2, "l2").collect()] == [1, 3]
    assert [r["id"] for r in knn.nearest(v, [0.0, 0.0], 100, "l2").collect()] == [1, 3, 2]
    assert knn.nearest(v, [0.0, 0.0], 0, "l2").count() == 0
    assert knn.nearest(v.limit(0), [0.0, 0.0], 5, "l2").count() == 0
    assert [r["id"] for r in knn.nearest(v, [1.0, 0.0], 1, "dot").collect()] == [2]


def test_collinear(spark):
    v = vectors(spark, [(i, [float(i), 0.0]) for i in range(100)])
    got = [r["id"] for r in knn.nearest(v, [50.0, 0.0], 5, "l2").collect()]
    assert got == [50, 49, 51, 48, 52]


def test_tombstones_and_repeated_ids(spark):
    v = vectors(spark, [(1, [3.0]), (1, [1.0]), (2, [2.0]), (3, [0.0])])
    dead = spark.createDataFrame([(3,), (3,), (None,)], "id bigint")
    assert [tuple(r) for r in knn.nearest_live(v, dead, [0.0], 5, "l2").collect()] == [(1, 1.0), (2, 4.0)]


@pytest.mark.parametrize("metric,block,few", list(itertools.product(["l2", "cosine", "dot"], [7, 1000], [0, 100])))
def test_batch_matches_brute_force(spark, metric, block, few, monkeypatch):
    monkeypatch.setattr(knn, "FEW", few)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)).astype("f4")
    x[10] = x[11]
    rows = [(int(i), "a" if i % 3 else "b", x[i].tolist()) for i in range(60)] + [(90, "a", None), (91, None, x[0].tolist()), (92, "a", [1.0])]
    v = spark.createDataFrame(rows, "id bigint, scope string, vec array<float>")
    q = spark.createDataFrame([(1, "a", x[10].tolist(), 5), (2, "b", x[1].tolist(), 50), (3, "c", x[2].tolist(), 5), (4, "a", x[2].tolist(), 0), (5, None, x[2].tolist(), 3)], "qid bigint, scope string, vec array<float>, k int")
    got = {}
    for r in knn.batch_nearest(q, v, metric, ["scope"], block).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    for qid, scope, vec, k in ((1, "a", x[10], 5), (2, "b", x[1], 50)):
        ids = [i for i in range(60) if ("a" if i % 3 else "b") == scope]
        m = x[ids].astype("f8")
        vec = vec.astype("f8")
        d = {"l2": ((m - vec) ** 2).sum(1), "dot": -(m @ vec), "cosine": 1 - m @ vec / (np.linalg.norm(m, axis=1) * np.linalg.norm(vec))}[metric]
        want = [i for _, i in sorted(zip(np.round(d, 9), ids))][:k]
        assert got[qid] == want
    assert set(got) == {1, 2}


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_batch_keeps_precision_and_large_values(spark, metric):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 8)).astype("f4")
    x[40:60] = x[0] * (1 + 1e-6 * rng.normal(size=(20, 8)))
    x[60:] *= np.float32(1e25)
    x[79] = 0
    v = spark.createDataFrame([(int(i), x[i].tolist()) for i in range(80)], "id bigint, vec array<float>")
    got = {}
    for r in knn.batch_nearest(v.selectExpr("id AS qid", "vec", "30 AS k"), v, metric).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["id"])
    m = x.astype("f8")
    for i in range(80):
        norms = np.maximum(np.linalg.norm(m, axis=1) * np.linalg.norm(m[i]), 1.1920928955078125e-07)
        d = {"l2": ((m - m[i]) ** 2).sum(1), "dot": -np.einsum("ij,j->i", m, m[i]), "cosine": 1 - np.einsum("ij,j->i", m, m[i]) / norms}[metric]
        assert got[i] == [j for _, j in sorted(zip(np.round(d, 9), range(80)))][:30]


def test_partitioned_index(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 8)) * 4
    x = (centres[rng.integers(20, size=1500)] + rng.normal(size=(1500, 8))).astype("f4")
    rows = [(int(i), x[i].tolist(), int(i % 100), 1.5) for i in range(1500)] + [(5000, None, 0, 0.0), (5001, [1.0], 0, 0.0), (None, x[0].tolist(), 0, 0.0)]
    v = spark.createDataFrame(rows, "id bigint, vec array<float>, tag int, cell_size double")
    q = v.where("id % 30 = 0 AND id < 1500").selectExpr("id AS qid", "vec", "10 AS k")
    for metric in ("l2", "cosine"):
        indexed, book = ivf.build(v, 8, metric, cells=24)
        assert indexed.count() == 1500 and set(indexed.columns) == {"id", "vec", "tag", "cell_size", "cell"}
        found = ivf.search(q, indexed, book)
        assert knn.recall_at_k(found, knn.batch_nearest(q, v.select("id", "vec"), metric)).first()["recall"] >= 0.9
        rare = ivf.search(q, indexed.where("tag = 7"), book)  # 15 rows pass: found only in all cells together
        exact = knn.batch_nearest(q, v.where("tag = 7").select("id", "vec"), metric)
        assert rare.count() == 500 and knn.recall_at_k(rare, exact).first()["recall"] >= 0.7
    empty = v.limit(0)
    indexed, book = ivf.build(empty, 8, "l2")
    assert indexed.count() == 0 and ivf.search(q, indexed, book).count() == 0


def test_recall_at_k(spark):
    exact = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "qid int, id int")
    found = spark.createDataFrame([(1, 1), (1, 9), (2, 3), (2, 4)], "qid int, id int")
    assert knn.recall_at_k(found, exact).first()["recall"] == 0.75
    assert knn.recall_at_k(found, exact.limit(0)).first()["recall"] == 1.0


def test_append_ids(spark):
    new = spark.createDataFrame([("b",), ("a",)], "x string")
    old = spark.createDataFrame([(500,)], "id bigint")
    assert [tuple(r) for r in knn.append_ids(old, new, ["x"]).select("x", "id").orderBy("id").collect()] == [("a", 501), ("b", 502)]
    assert {r["id"] for r in knn.append_ids(old.limit(0), new, ["x"]).collect()} == {1, 2}


def meta(spark):
    rows = [(1, {"color": ["red"], "size": ["large"]}), (2, {"color": ["red", "pink"], "size": ["small"]}), (3, {"color": ["blue"]}), (4, None), (5, {})]
    return spark.createDataFrame(rows, "id int, metadata map<string,array<string>>")


def test_filters(spark):
    df = meta(spark)

    def ids(f):
        return [r["id"] for r in df.where(f.column(F.col("metadata"))).orderBy("id").collect()]

    assert ids(And((Equals("color", "red"), Equals("size", "large")))) == [1]
    assert ids(Equals("color", "pink")) == [2]
    assert ids(In("color", ("blue", "pink"))) == [2, 3]
    assert ids(Or((Equals("size", "small"), Equals("color", "blue")))) == [2, 3]
    assert ids(Not(Equals("size", "large"))) == [2, 3]
    assert ids(And(())) == ids(Or(())) == ids(In("color", ())) == []
    assert filters.from_dict({}) is None
    assert ids(filters.from_dict({"color": ["red"], "size": "small"})) == [2]
    with pytest.raises(TypeError):
        filters.from_dict({"a": 1})
    assert filters.selectivity(df, Equals("color", "red")).first()["selectivity"] == 2 / 3
    assert filters.selectivity(df.limit(0), Equals("color", "red")).first()["selectivity"] == 1.0


def test_index(spark, tmp_path):
    ix = Index(spark, 3, "dot", str(tmp_path / "ix"))
    assert ix.is_empty() and ix.search([1, 0, 0], 3) == []
    assert ix.insert([1, 0, 0], {"c": "red"}) == 1
    assert ix.insert_batch(np.array([[2, 0, 0], [0, 1, 0]], dtype=np.float32), [{"c": "blue"}]) == [2, 3]
    assert ix.search([1, 0, 0], 1)[0][0] == 2
    ix.compact()
    assert ix.delta_len() == 0 and ix.num_sealed() == 1 and len(ix) == 3
    assert ix.insert_with_id(500, [9, 0, 0]) == 500 and ix.insert([0, 0, 1]) == 501
    assert [i for i, _ in ix.search(np.array([1, 0, 0], dtype=np.float32), 2, {"c": ["red", "blue"]})] == [2, 1]
    assert ix.search([1, 0, 0], 0) == []
    with pytest.raises(ValueError, match="DIMENSION_MISMATCH"):
        ix.insert([1.0])
    for bad in (np.zeros(3), np.zeros((1, 3), np.float32), np.zeros(3, np.int32)):
        with pytest.raises(TypeError):
            ix.insert(bad)
    with pytest.raises(ValueError):
        ix.insert(np.zeros(6, np.float32)[::2])
    with pytest.raises(ValueError):
        ix.insert_with_id(2**63, [1, 1, 1])


def test_synthetic_vectors(spark):
    from palimpsest.sources.synthetic import uniform_vectors

    a, b = uniform_vectors(spark, 50, 4).collect(), uniform_vectors(spark, 50, 4).repartition(3).orderBy("id").collect()
    assert a == b and all(len(r["vec"]) == 4 and all(0 <= x < 1 for x in r["vec"]) for r in a)
    assert len({tuple(r["vec"]) for r in a}) == 50


def test_batch_searches_equal_sql_for_all_queries(spark, tmp_path):
    import duckdb

    from palimpsest.plans import reference_queries, reference_sql

    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).astype("f4").tolist(), i % 6) for i in range(1, 401)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
        for name in [f"filter_{f}" for f in reference_queries.FILTERS] + ["distance_to", "union_delta_sealed", "anti_tombstone", "semi_filter"]:
            got = reference_queries.QUERIES[f"vec_batch_{name}"](spark, str(tmp_path)).collect()
            want = db.execute(reference_sql.SQL[f"vec_batch_{name}"]).fetchall()
            assert len(got) == len(want) == {"filter_empty_and": 0, "distance_to": 1600}.get(name, 40), name
            assert np.allclose(sorted(map(tuple, got)), sorted(want), atol=2e-6), name


def test_index_survives_reopening(spark, tmp_path):
    at = str(tmp_path / "ix")
    ix = Index(spark, 2, "l2", at)
    assert [ix.insert([0.0, 1.0]), ix.insert([1.0, 0.0], {"c": "x"})] == [1, 2]
    ix.compact()
    again = Index(spark, 2, "l2", at)
    assert len(again) == 2 and again.num_sealed() == 1 and again.insert([2.0, 2.0]) == 3
    again.insert_with_id(40, [3.0, 3.0])
    again.compact()
    third = Index(spark, 2, "l2", at)
    assert len(third) == 4 and third.insert([9.0, 9.0]) == 41 and [i for i, _ in third.search([3.0, 3.0], 2)] == [40, 3]
    third.insert_frame(spark.createDataFrame([(100, [5.0, 5.0], None), (101, [5.0], None)], "id bigint, vec array<float>, metadata map<string,array<string>>"))
    fourth = Index(spark, 2, "l2", at)  # what wasn't sealed is gone, the part is there
    assert sorted(r["id"] for r in fourth.frame().collect()) == [1, 2, 3, 40, 100] and fourth.insert([0.0, 0.0]) == 101
    # without any manifest, the finished parts are listed; an unfinished one doesn't count and isn't overwritten
    for f in (tmp_path / "ix").glob("manifest-*"):
        f.unlink()
    (tmp_path / "ix" / "part-000000009").mkdir()
    fifth = Index(spark, 2, "l2", at)
    assert len(fifth) == 5 and fifth.insert([7.0, 7.0]) == 101
    fifth.compact()
    assert (tmp_path / "ix" / "part-000000010" / "_SUCCESS").exists()
    # a manifest that was cut off falls back to the one before
    newest = max((tmp_path / "ix").glob("manifest-*"))
    (tmp_path / "ix" / "manifest-000000099.json").write_text(newest.read_text()[:20])
    assert len(Index(spark, 2, "l2", at)) == 6


def test_index_upsert_and_remove(spark, tmp_path):
    ix = Index(spark, 1, "l2", str(tmp_path / "ix"))
    ix.upsert(7, [1.0])
    ix.upsert(7, [2.0])
    ix.upsert(8, [5.0])
    assert ix.search_records([0.0], 5) == [(7, 1.0), (8, 25.0)] and len(ix.search([0.0], 5)) == 3
    ix.remove([7, 99])
    ix.compact()
    ix = Index(spark, 1, "l2", str(tmp_path / "ix"))
    assert ix.search_records([0.0], 5) == [(8, 25.0)]
    ix.upsert(7, [3.0])
    assert ix.search_records([0.0], 5) == [(7, 9.0), (8, 25.0)]


def test_index_approximate_search(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 4)).astype("f4")
    ix = Index(spark, 4, "cosine", str(tmp_path / "ix"))
    ix.insert_batch(x, [{"parity": "even" if i % 2 else "odd"} for i in range(400)])
    assert ix.search_approximate(x[3], 3) == ix.search(x[3], 3)
    assert ix.train(cells=8) >= 0.95
    ix = Index(spark, 4, "cosine", str(tmp_path / "ix"))
    late = ix.insert(x[3], {"parity": "odd"})
    got, want = ({i for i, _ in f(x[3], 10)} for f in (ix.search_approximate, ix.search))
    assert {4, late} <= got and len(got & want) >= 8
    assert len(ix.search_approximate(x[3], 200, {"parity": "even"})) == 200
    ix.remove(4)
    assert 4 not in {i for i, _ in ix.search_approximate(x[3], 10)}
