from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.ordered import previous_row, running_totals


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_running_totals_and_previous_row_cross_partitions(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        rows = [("hot", i, float(i % 5)) for i in range(300)] + [("x", i, 1.0) for i in range(3)] + [(None, i, None) for i in range(4)] + [("", 1, 2.0)]
        df = spark.createDataFrame(rows, "k string, i int, w double").repartition(3)
        totals, count = defaultdict(float), defaultdict(int)
        want, seen = {}, {}
        for k, i, w in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
            totals[k] += w or 0
            count[k] += 1
            want[(k, i)] = (totals[k], count[k])
            seen[(k, i)] = i - 1 if (k, i - 1) in seen else None
        a = {(r["k"], r["i"]): r["t"] for r in running_totals(df, ["k"], [F.col("i")], "w", "t").collect()}
        b = {(r["k"], r["i"]): r["t"] for r in running_totals(df, ["k"], [F.col("i")], None, "t").collect()}
        assert a == {k: v[0] for k, v in want.items()}
        assert b == {k: v[1] for k, v in want.items()}
        p = {(r["k"], r["i"]): r["p"] for r in previous_row(df, ["k"], [F.col("i")], {"i": "p"}).collect()}
        assert p == seen
        assert running_totals(df.limit(0), ["k"], [F.col("i")], "w", "t").count() == 0
        assert previous_row(df.limit(0), ["k"], [F.col("i")], {"i": "p"}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
