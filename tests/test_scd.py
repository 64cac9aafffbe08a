from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemill.operators import scd

T = [datetime(2024, m, 1) for m in range(1, 7)]
COLS = "k long, a string, b long"


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


def empty(spark, df, kind, tracked=("a", "b")):
    return spark.createDataFrame([], scd.empty_target(df, kind, tracked))


def state(df, *columns, order=("k", "version")):
    return [tuple(r) for r in df.orderBy(*order).select(*columns).collect()]


def test_scd2_versions_intervals_and_nulls(spark):
    first = batch(spark, (1, "x", 1), (2, None, 2))
    h = scd.scd2(empty(spark, first, 2), first, ("k",), ("a", "b"), T[0])
    h = scd.scd2(h, batch(spark, (1, None, 1), (2, "y", 2), (3, "n", 3)), ("k",), ("a", "b"), T[1])
    h = scd.scd2(h, batch(spark, (1, None, 1)), ("k",), ("a", "b"), T[2])
    assert state(h, "k", "a", "version", "is_current") == [(1, "x", 1, False), (1, None, 2, True), (2, None, 1, False), (2, "y", 2, True), (3, "n", 1, True)]
    closed = {(r.k, r.version): (r.valid_from, r.valid_to) for r in h.collect()}
    assert closed[1, 1] == (T[0], T[1]) and closed[1, 2][0] == T[1] and closed[1, 2][1].year == 9999


def test_scd2_replay_changes_nothing(spark):
    b = batch(spark, (1, "x", 1), (2, "y", None))
    once = scd.scd2(empty(spark, b, 2), b, ("k",), ("a", "b"), T[0])
    twice = scd.scd2(once, b, ("k",), ("a", "b"), T[1])
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)


def test_scd1_keeps_created_and_updates_changed(spark):
    first = batch(spark, (1, "x", 1), (2, "y", 2))
    t = scd.scd1(empty(spark, first, 1), first, ("k",), ("a",), T[0])
    t = scd.scd1(t, batch(spark, (1, None, 9), (3, "z", 3)), ("k",), ("a",), T[1])
    got = {r.k: (r.a, r.b, r.created_at, r.updated_at) for r in t.collect()}
    assert got == {1: (None, 1, T[0], T[1]), 2: ("y", 2, T[0], T[0]), 3: ("z", 3, T[1], T[1])}


def test_scd3_moves_all_tracked(spark):
    first = batch(spark, (1, "x", 1))
    t = scd.scd3(empty(spark, first, 3), first, ("k",), ("a", "b"), T[0])
    assert t.collect()[0].prev_a is None
    t = scd.scd3(t, batch(spark, (1, "y", 1)), ("k",), ("a", "b"), T[1])
    r = t.collect()[0]
    assert (r.a, r.b, r.prev_a, r.prev_b) == ("y", 1, "x", 1)


def test_scd4_archives_what_it_overwrites(spark):
    first = batch(spark, (1, "x", 1), (2, "y", 2))
    t = scd.scd1(empty(spark, first, 4), first, ("k",), ("a", "b"), T[0])
    out = scd.scd4(t, batch(spark, (1, "q", 1), (2, "y", 2)), ("k",), ("a", "b"), T[1])
    assert [(r.k, r.a, r.snapshot_at) for r in out.history_rows.collect()] == [(1, "x", T[1])]
    assert {r.k: r.a for r in out.current.collect()} == {1: "q", 2: "y"}


def test_scd6_three_changes(spark):
    b = batch(spark, (1, "x", 1))
    h = empty(spark, b, 6, ("a",))
    for k, v in enumerate(("x", "y", "z")):
        h = scd.scd6(h, batch(spark, (1, v, 1)), ("k",), ("a",), T[k])
    assert state(h, "version", "a", "prev_a", "current_a", "is_current") == [(1, "x", None, "z", False), (2, "y", "x", "z", False), (3, "z", "y", "z", True)]


def test_rebuild_intervals_splits_for_a_late_row(spark):
    h = spark.createDataFrame([(1, "x", T[0], T[3], False, 1), (1, "z", T[3], datetime(9999, 12, 31), True, 2), (2, "q", T[0], datetime(9999, 12, 31), True, 1)], "k long, a string, valid_from timestamp, valid_to timestamp, is_current boolean, version long")
    late = spark.createDataFrame([(1, "y", T[1]), (1, "y", T[2])], "k long, a string, t timestamp")
    out = scd.rebuild_intervals(h, late, ("k",), ("a",), "t")
    assert state(out, "k", "a", "valid_from", "valid_to") == [(1, "x", T[0], T[1]), (1, "y", T[1], T[3]), (1, "z", T[3], datetime(9999, 12, 31)), (2, "q", T[0], datetime(9999, 12, 31))]


def test_as_of_and_valid_at(spark):
    h = spark.createDataFrame([(1, "x", T[0], T[2]), (1, "y", T[2], T[5])], "k long, a string, valid_from timestamp, valid_to timestamp")
    facts = spark.createDataFrame([(7, 1, T[2]), (8, 1, T[1]), (9, 2, T[1])], "f long, fk long, t timestamp")
    got = {r.f: r.a for r in scd.as_of_join(facts, h, {"fk": "k"}, "t").collect()}
    assert got == {7: "y", 8: "x", 9: None}
    assert [r.a for r in scd.valid_at(h, T[2]).collect()] == ["y"]


@pytest.mark.parametrize("seed", range(3))
def test_invariants_over_random_batches(spark, seed):
    import random

    rnd = random.Random(seed)
    h = None
    for t in T:
        b = batch(spark, *[(k, rnd.choice(["p", "q", None]), rnd.choice([1, 2])) for k in rnd.sample(range(8), 5)])
        h = scd.scd2(empty(spark, b, 2) if h is None else h, b, ("k",), ("a", "b"), t)
        h = spark.createDataFrame(h.collect(), h.schema)
    rows = sorted(h.collect(), key=lambda r: (r.k, r.version))
    for r, s in zip(rows, rows[1:]):
        if r.k == s.k:
            assert r.valid_to == s.valid_from and not r.is_current and s.version == r.version + 1
    assert h.filter("is_current").groupBy("k").count().agg(F.max("count")).collect()[0][0] == 1


def test_as_of_makes_no_pairs(spark):
    """A key with 20,000 versions and facts: the sequence has a row for each, and for each slice of time."""
    day = F.expr("TIMESTAMP '2020-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT) * 30, 0)")
    ids = spark.range(20_000)
    h = ids.select(F.lit(1).alias("k"), day.alias("valid_from"), F.expr("TIMESTAMP '2020-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT) * 30 + 20, 0)").alias("valid_to"), F.col("id").alias("v"))
    f = ids.select(F.lit(1).alias("k"), (day + F.expr("make_interval(0, 0, 0, 0, 0, CAST(id % 30 AS INT), 0)")).alias("at"), F.col("id").alias("n"))
    got = scd.as_of_join(f, h, {"k": "k"}, "at", slice_days=20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert {(r.miss, r.right, r["count"]) for r in got.groupBy((F.col("v").isNull()).alias("miss"), (F.col("v") == F.col("n")).alias("right")).count().collect()} == {(False, True, 13_340), (True, None, 6_660)}


def test_as_of_odd_rows(spark):
    h = spark.createDataFrame([(1, "a", T[0], T[1]), (1, "b", T[1], T[2]), (None, "n", T[0], T[2]), (2, "z", T[1], T[1])], "k long, v string, valid_from timestamp, valid_to timestamp")
    f = spark.createDataFrame([(1, T[0], "x"), (1, T[1], "y"), (1, T[2], "z"), (1, None, "t"), (None, T[0], "k"), (2, T[1], "e"), (1, datetime(2030, 1, 1), "late")], "k long, at timestamp, v string")
    got = scd.as_of_join(f, h, {"k": "k"}, "at", slice_days=1)
    assert got.columns == ["k", "at", "v", "_h_v", "valid_from", "valid_to"]
    assert {(r.v, r._h_v) for r in got.collect()} == {("x", "a"), ("y", "b"), ("z", None), ("t", None), ("k", None), ("e", None), ("late", None)}
    assert scd.as_of_join(f, h, {"k": "k"}, "at", how="inner").count() == 2 and scd.as_of_join(f, h.limit(0), {"k": "k"}, "at").count() == 7
