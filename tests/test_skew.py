"""The dealt-out paths against plain Python, with one group holding a third of the rows."""

import random

import pytest

from tests.frames import frame, rows
from viewloom.operators import selection, skew
from viewloom.operators.skew import hot_keys, lookup, numbered, sum_before


@pytest.fixture
def low_floor(monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 75)
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)


def skewed(n=600, seed=3):
    rng = random.Random(seed)
    order = list(range(n))
    rng.shuffle(order)
    return [(o, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(-5, 9)) for i, o in enumerate(order)]


def test_hot_keys_are_few_and_sized(spark, low_floor):
    df = frame(spark, skewed(), "o int, k string, v int")
    got = rows(hot_keys(df, ["k"], ["h"]), "h", "_slots")
    assert got == [("hot", -(-200 // 75))]


def test_no_hot_keys_below_the_floor(spark):
    assert hot_keys(frame(spark, skewed(), "o int, k string, v int"), ["k"], ["h"]) is None


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("small", [0, 100])
def test_lookup_with_a_hot_key(spark, low_floor, monkeypatch, how, small):
    monkeypatch.setattr(skew, "SMALL_ROWS", small)
    data = skewed() + [(1000 + i, None, 0) for i in range(300)]
    left = frame(spark, data, "o int, k string, v int")
    known = [("hot", 1), ("k1", 2), ("k2", 3), (None, 4), ("unused", 5)]
    right = frame(spark, known, "name string, w int")
    got = rows(lookup(left, right, {"k": "name"}, how, ["o"]), "o", *([] if how == "left_semi" else ["w"]))
    at = dict(known)
    if how == "inner":
        expected = [(o, at[k]) for o, k, _ in data if k in at]
    elif how == "left":
        expected = [(o, at.get(k)) for o, k, _ in data]
    else:
        expected = [(o,) for o, k, _ in data if k in at]
    assert got == sorted(expected)


def test_hot_key_missing_on_the_right(spark, low_floor):
    left = frame(spark, skewed(), "o int, k string, v int")
    right = frame(spark, [("k1", 2)], "name string, w int")
    assert lookup(left, right, {"k": "name"}, "inner", ["o"]).where("k = 'hot'").count() == 0
    assert lookup(left, right, {"k": "name"}, "left", ["o"]).where("k = 'hot' and w is null").count() == 200


def expected_before(data, grouped):
    seen, out = {}, []
    for o, k, v in sorted(data):
        n, s = seen.get(k if grouped else None, (0, 0))
        out.append((o, n, s))
        seen[k if grouped else None] = (n + 1, s + v)
    return out


@pytest.mark.parametrize("grouped", [False, True])
@pytest.mark.parametrize("per_task, small", [(3, 0), (30, 1000), (100_000, 1000)])
def test_sum_before(spark, monkeypatch, grouped, per_task, small):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", per_task)
    monkeypatch.setattr(skew, "SMALL_ROWS", small)
    data = skewed()
    df = frame(spark, data, "o int, k string, v int").repartition(5)
    sums = {"n": skew.F.lit(1), "s": skew.F.col("v")}
    assert rows(sum_before(df, "o", sums, ["k"] if grouped else []), "o", "n", "s") == expected_before(data, grouped)


def test_slices_of_a_large_frame(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 1000)
    df = spark.range(20000).selectExpr("named_struct('a', -id, 'b', 'x') o", "id")
    assert numbered(df, "o").where("index <> 19999 - id").count() == 0


def largest_task(df):
    """Rows of the largest task of a frame's last stage."""
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


@pytest.mark.parametrize("spread", [None, ["o"]])
def test_flagging_a_hot_key_spreads_it(spark, monkeypatch, spread):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    data = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)]
    df = frame(spark, data, "o int, k string")
    keys = selection.keys(spark, ["hot", *[f"k{i}" for i in range(0, 3000, 30)]])
    asked = {"shuffle.partitions": "30", "adaptive.enabled": "false", "autoBroadcastJoinThreshold": "-1"}
    before = {f"spark.sql.{c}": spark.conf.get(f"spark.sql.{c}") for c in asked}
    for c, value in asked.items():
        spark.conf.set(f"spark.sql.{c}", value)
    try:
        lit = selection.flag(df, ["k"], keys, spread)
        assert largest_task(lit) <= 5 * 100
        assert lit.where("lit").count() == 2000 + 100
        assert selection.only(df, ["k"], keys, spread).count() == 2100
    finally:
        for c, value in before.items():
            spark.conf.set(c, value)


def test_wide_rows_are_not_broadcast(spark, monkeypatch):
    left = spark.range(100).selectExpr("id", "'x' pad")
    right = spark.range(50).selectExpr("id as key", "repeat('y', 10000) as text")
    assert skew.is_small(right)
    assert "Broadcast" in lookup(left, right, {"id": "key"}, "inner")._jdf.queryExecution().optimizedPlan().toString().replace("broadcast", "Broadcast")
    monkeypatch.setattr(skew, "SMALL_BYTES", 400_000)
    assert not skew.is_small(right)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lookup(left, right, {"id": "key"}, "inner")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Broadcast" not in plan


def test_lists_and_objects_count_in_bytes(spark):
    df = spark.range(1).selectExpr("id", "array_repeat('abcdefgh', 1000) as l", "map('k', repeat('z', 5000)) as m")
    assert df.select(skew._width(df)).first()[0] > 13_000


def test_empty_frames(spark, low_floor):
    df = frame(spark, [], "o int, k string, v int")
    assert sum_before(df, "o", {"n": skew.F.lit(1)}, ["k"]).count() == 0
    assert numbered(df, "o").count() == 0
    assert lookup(df, df.selectExpr("k as n"), {"k": "n"}, "left_semi", ["o"]).count() == 0
