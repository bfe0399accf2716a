import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import changefeed, history, oplog

from .frames import memories, operations, snapshots


def op(i, m, kind, rev, at, importance=None, state="applied"):
    payload = None if rev is None else '{"revision":%d%s}' % (rev, "" if importance is None else ',"importance":%s' % importance)
    return (i, m, kind, payload, state, at, None)


def test_change_feed(spark):
    rows = [
        op("a1", "a", "remember", 1, 10, 0.1), op("a2", "a", " UPDATE\t", 2, 20, 0.2), op("a2", "a", "update", 2, 15, 0.2), op("a3", "a", "update", 3, 30),
        op("b1", "b", "remember", 1, 10), op("b2", "b", "delete", 2, 20), op("b3", "b", "update", 3, 30),
        op("c1", "c", "update", 1, 10), op("c2", "c", "remember", 1, 20, 0.5), op("c3", "c", "delete", 2, 30), op("c4", "c", "remember", 1, 40),
        op("d2", "d", "update", 2, 10), op("d1", "d", "remember", 1, 10),
        op("e1", "e", "remember", None, None), op("x", None, "remember", 1, 1), op("y", " ", "remember", 1, 1), op("f1", "f", "noise", 1, 1),
        op(None, "g", "remember", 1, 5), op(None, "g", "remember", 1, 5),
        ("h1", "h", "remember", '{"revision":1,"impor', "pending", 1, None),
    ]
    random.Random(3).shuffle(rows)
    feed = operations(spark, rows)
    got = {r["memory_id"]: r["operation_id"] for r in changefeed.last_effective_operation(feed).collect()}
    assert got == {"a": "a3", "c": "c4", "d": "d2", "e": "e1", "g": None, "h": "h1"}
    state = {r["memory_id"]: r for r in changefeed.current_state(feed).collect()}
    assert set(state) == set(got)
    assert state["a"]["importance"] == 0.2 and state["a"]["revision"] == 3
    assert state["c"]["importance"] is None  # set before the delete only
    assert changefeed.last_effective_operation(feed.limit(0)).count() == 0
    assert changefeed.current_state(feed.limit(0)).count() == 0
    twice = feed.unionByName(feed)
    assert {tuple(r) for r in changefeed.last_effective_operation(twice).collect()} == {tuple(r) for r in changefeed.last_effective_operation(feed).collect()}


def test_operation_log(spark):
    feed = operations(spark, [
        op("a1", "a", "remember", 1, 10), op("a2", "a", "update", 2, 20), op("a3", "a", "update", 9, 30, state="pending"), op("a3", "a", "update", 9, 31, state="pending"),
        op("b1", "b", "update", 1, 10), op("c1", "c", "remember", 1, 1), op("c2", "c", "delete", 2, 2, state=" Pending"), op("c2", "c", "delete", 2, 3, state="applied"),
        op("d1", "d", "remember", 1, 1), op("d2", "d", "delete", 2, 2, state="pending"), op(None, "z", "remember", 1, 1),
    ])
    assert {r["operation_id"] for r in oplog.pending(feed).collect()} == {"a3", "d2"}
    assert {(r["operation_id"], r["outcome"]) for r in oplog.update_outcomes(feed).collect()} == {("a2", "applied"), ("a3", "revision_conflict"), ("b1", "not_found")}
    known = memories(spark, [{"id": "a"}, {"id": "d"}])
    assert {(r["memory_id"], r["action"]) for r in oplog.recovered(feed, known).collect()} == {("a", "upsert"), ("d", "remove")}
    assert {(r["memory_id"], r["action"]) for r in oplog.recovered(feed, known.withColumn("status", F.lit("deleted"))).collect()} == {("a", "applied"), ("d", "remove")}
    assert {(r["memory_id"], r["action"]) for r in oplog.recovered(feed, known.limit(0)).collect()} == {("a", "left"), ("d", "remove")}
    assert {r["memory_id"] for r in oplog.tombstones(feed).collect()} == {"c", "d"}
    for f in (oplog.pending, oplog.update_outcomes, lambda log: oplog.recovered(log, known), oplog.tombstones):
        assert f(feed.limit(0)).count() == 0


def brute_outcomes(rows):
    alive, out = {}, {}
    for i, m, kind, rev, at in sorted(rows, key=lambda r: (r[1], r[4], -1 if r[3] is None else r[3], r[0])):
        if kind == "update":
            if m not in alive:
                out[i] = (None, "not_found")
            elif rev is not None and alive[m] is not None and rev == alive[m] + 1:
                out[i], alive[m] = (alive[m], "applied"), rev
            else:
                out[i] = (alive[m], "revision_conflict")
        elif kind == "remember":
            alive[m] = rev
        else:
            alive.pop(m, None)
    return out


def test_updates_after_deletions_and_rejections(spark):
    rows = [("1", "a", "remember", 1, 1), ("2", "a", "update", 5, 2), ("3", "a", "update", 2, 3), ("4", "a", "delete", 3, 4), ("5", "a", "update", 4, 5), ("6", "a", "update", 5, 6), ("7", "a", "remember", 1, 7), ("8", "a", "update", 2, 8)]
    got = {r["operation_id"]: (r["current_revision"], r["outcome"]) for r in oplog.update_outcomes(operations(spark, [op(*r) for r in rows])).collect()}
    assert got == {"2": (1, "revision_conflict"), "3": (1, "applied"), "5": (None, "not_found"), "6": (None, "not_found"), "8": (1, "applied")}


@pytest.mark.parametrize("seed,calm", [(1, 0.0), (2, 0.9), (3, 1.0)])
def test_outcomes_of_a_hot_memory_over_partitions(spark, seed, calm):
    rng = random.Random(seed)
    rows, rev = [("0", "hot", "remember", 1, 0)], 1
    for n in range(1, 400):
        kind = "update" if rng.random() < calm else rng.choice(["update", "update", "remember", "delete"])
        rev = rng.choice([rev + 1, rev + 1, rev, rev + 2, None]) or rev
        rows.append((f"{n}", "hot" if rng.random() < 0.9 else rng.choice("ax"), kind, rng.choice([rev, rev, rev, None]), n))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = oplog.update_outcomes(operations(spark, [op(*r) for r in rows])).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {r["operation_id"]: (r["current_revision"], r["outcome"]) for r in got} == brute_outcomes(rows)


def brute_history(rows):
    states = {}
    for i, at, rev, imp, st in rows:
        if None in (i, at, imp, st) or imp != imp or not st.strip():
            continue
        s = (-1 if rev is None else rev, round(imp, 4), st.strip().lower())
        states.setdefault(i, {})[at] = max(states.get(i, {}).get(at, (-2, 0, "")), s)
    out = set()
    for i, by in states.items():
        starts, last = [], None
        for at in sorted(by):
            if by[at][1:] != last:
                starts.append(at)
                last = by[at][1:]
        out |= {(i, a, b) for a, b in zip(starts, [*starts[1:], -1])}
    return out


@pytest.mark.parametrize("seed,partitions", [(1, 1), (2, 4), (3, 11)])
def test_history(spark, seed, partitions):
    rng = random.Random(seed)
    rows = []
    for week in range(5):
        for _ in range(60):
            i = rng.choice(["hot", "hot", "hot", "a", "b", "c", "d", None])
            rows.append((week, i, "t", "n", rng.choice([1, 2, 3, None]), rng.choice([0.1, 0.10001, 0.2, None, float("nan")]), rng.choice(["active", "ACTIVE ", "deleted", None, " "]), rng.randrange(40) if rng.random() > 0.05 else None))
    rows += rows[:20] + [(None, "a", "t", "n", 1, 0.3, "active", 99)]
    now = [{"id": r[1], "revision": r[4], "importance": r[5], "status": r[6], "updated_at_ms": r[7]} for r in rng.sample(rows, 25)]
    snap, mem = snapshots(spark, rows), memories(spark, now)
    want = brute_history([(r[1], r[7], r[4], r[5], r[6]) for r in rows] + [(m["id"], m["updated_at_ms"], m["revision"], m["importance"], m["status"]) for m in now])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = [(r["id"], r["valid_from_ms"], r["valid_to_ms"]) for r in history.history(snap, mem, leaf_rows=2).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == want


def test_history_empty(spark):
    assert history.history(snapshots(spark, []), memories(spark, [])).count() == 0
    one = history.history(snapshots(spark, []), memories(spark, [{"id": "a", "updated_at_ms": 5}])).collect()
    assert [(r["id"], r["valid_from_ms"], r["valid_to_ms"]) for r in one] == [("a", 5, -1)]
