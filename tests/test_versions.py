"""Versions of a store, and the stored tree, links and dictionary."""

import json

import pytest

from viewloom import Dashboard, HierarchySpec
from viewloom.operators import hierarchy, incidence, links, selection, skew
from viewloom.sources.records import read_records
from viewloom.sources.versions import Refused, Store, watch_versions
from viewloom.streaming import clicks

SCHEMA = "a int, b string"


def lines(path, rows, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows) + tail)
    return str(path)


def test_a_bad_load_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(LookupError):
        store.read()
    load = lambda name, tail="", **more: store.load(read_records(spark, lines(tmp_path / name, [{"a": 1}, {"a": 2}], tail), lines=True, schema=SCHEMA, keep_bad=name != "two"), **more)
    assert load("one") == 1 and store.current() == 1
    with pytest.raises(Refused):
        load("two", '\n{"a": ')
    with pytest.raises(Refused):
        load("bad", '\n{"a": ')
    old = store.read()
    assert store.current() == 1 and store.refusals() == [2, 3] and old.count() == 2
    assert load("three") == 4 and store.versions() == [1, 4]
    with pytest.raises(Refused):
        load("four", check=lambda written: written.count() > 2)
    assert store.current() == 4 and old.count() == 2 and store.read(1).count() == 2
    with pytest.raises(LookupError):
        store.read(3)
    assert load("again", number=4) == 4 and store.versions() == [1, 4]  # a published version is left alone


def test_watching_goes_on_past_a_bad_file(spark, tmp_path):
    store, folder = Store(spark, str(tmp_path / "store")), tmp_path / "in"
    for step, tail in enumerate(["", '\n{"a": ', ""]):
        lines(folder / f"{step}.json", [{"a": step, "b": "x"}], tail)
        watch_versions(spark, str(folder), SCHEMA, store, str(tmp_path / "progress"), once=True).awaitTermination()
        assert store.current() == [1, 1, 3][step]
    assert [r.a for r in store.read(1).collect()] == [0] and [r.a for r in store.read().collect()] == [2]


LOG = [
    ("s", 1, "add", "a"), ("s", 2, "add", "b"), ("s", 3, "remove", "a"), ("s", 4, "add", "c"), ("t", 1, "add", "a"), ("t", 2, "clear", None), ("t", 3, "add", "b"),
    ("u", 5, "clear", None), ("u", 4, "add", "x"), ("u", 6, "remove", "y"), (None, 1, "add", "a"), ("s", None, "add", "z"), ("s", 9, "add", None), ("s", 9, "what", "q"), ("s", 2, "add", "b"),
]


def test_clicks_in_a_stream_and_at_once(spark, tmp_path):
    schema = "session string, at bigint, action string, key string"
    want = {("s", "b", 2), ("s", "c", 4), ("t", "b", 3)}
    assert {tuple(r) for r in clicks.selected(spark.createDataFrame(LOG, schema)).collect()} == want
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", clicks.ROCKSDB)
    names = ["session", "at", "action", "key"]
    for step, rows in enumerate([LOG[8:], LOG[:5], LOG[5:8] + LOG[:2]]):  # late, and some again
        lines(tmp_path / "in" / f"{step}.json", [{n: v for n, v in zip(names, r) if v is not None} for r in rows])
        arriving = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        clicks.watch_clicks(arriving, str(tmp_path / "out"), str(tmp_path / "progress"), once=True).awaitTermination()
    assert {tuple(r) for r in clicks.selected(spark.read.parquet(str(tmp_path / "out"))).collect()} == want


def test_a_grown_dictionary_keeps_its_numbers(spark):
    schema = "key string, kind string, index long, group long"
    known = spark.createDataFrame([("b", "text", 0, 0), ("gone", "text", 1, 1), ("1", "number", 2, 2)], schema)
    fresh = spark.createDataFrame([("1", "text", 0, 0), ("a", "text", 1, 1), ("b", "text", 2, 2), ("1", "number", 3, 3)], schema)
    got = sorted((r["index"], r.key, r.kind) for r in selection.extended_dictionary(known, fresh, groups=3).collect())
    assert got == [(0, "b", "text"), (1, "gone", "text"), (2, "1", "number"), (3, "1", "text"), (4, "a", "text")]
    empty = known.limit(0)
    assert sorted(r["index"] for r in selection.extended_dictionary(empty, fresh).collect()) == [0, 1, 2, 3]


def test_intervals(spark):
    rows = [(0, "A", "x", 5.0), (1, "A", "y", 3.0), (2, "A", "x", 2.0), (3, "B", "A", 4.0), (4, "B", "z", None), (5, None, "x", 1.0), (6, "B", "w", 1.0)]
    df = spark.createDataFrame(rows, "ord int, l1 string, l2 string, v double")
    board = Dashboard(df, hierarchy=HierarchySpec(["l1", "l2"], "v", "ord"))
    got = {tuple(r.path): (r.enter, r.leave) for r in board.tree_intervals.collect()}
    assert got == {(): (0, 9), ("A",): (1, 3), ("A", "x"): (2, 2), ("A", "y"): (3, 3), ("B",): (4, 7), ("B", "A"): (5, 5), ("B", "z"): (6, 6), ("B", "w"): (7, 7), (None,): (8, 9), (None, "x"): (9, 9)}
    for prefix in (["B"], [None]):
        both = [sorted(((r.path, r.x0, r.x1, r.y0, r.value) for r in f.collect()), key=repr) for f in (board.zoom(prefix), board.drill(prefix))]
        assert both[0] == both[1]
    assert {tuple(r.path) for r in board.way_to(["B", "z"]).collect()} == {(), ("B",), ("B", "z")}
    plan = board.zoom(["B"])._jdf.queryExecution().executedPlan().toString()
    assert "LogicalRDD" not in plan and "Scan ExistingRDD" not in plan  # the records are not read again
    plain, ranged = hierarchy.layout(board.tree, 2), hierarchy.layout(board.tree_intervals, 2)
    for names in (["x"], ["nope"]):
        flags = [{tuple(r.path): r.lit for r in selection.flag_tree(t, selection.keys(spark, names)).collect()} for t in (plain, ranged)]
        assert flags[0] == flags[1]


def test_links_by_their_ends(spark, monkeypatch):
    rows = [(i, 0, f"n{i % 5}", f"n{i % 3}") for i in range(40)] + [(99, 0, "hub", f"n{k}") for k in range(5)] + [(100, 1, None, "n1")]
    found = spark.createDataFrame(rows, "ord int, pos int, source string, target string")
    for per_task in (4,):
        monkeypatch.setattr(skew, "ROWS_PER_TASK", per_task)
        index = incidence.index(found, buckets=7)
        for node in ("n1", "hub", "nope"):
            assert sorted(map(tuple, index.incident(node).collect())) == sorted(map(tuple, links.touching(found, node).collect()))
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are left out without a word
        plan = index.incident("n1")._jdf.queryExecution().executedPlan().toString()
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
        assert "SelectedBucketsCount: 1 out of 7" in plan
        index.drop()


def test_key_order(spark):
    from viewloom.operators import profile
    from viewloom.sources.records import parse_variants

    rows = [(0, '{"z":null,"b":1,"a":{"y":1}}'), (1, '{"c":true,"z":"t"}'), (2, "[1]"), (3, '{"a":"s","z":2}')]
    records = parse_variants(spark.createDataFrame(rows, "ord int, line string"), "line")
    got = {r.key: (r.kind, r.first_seen, r.position) for r in profile.variant_profile(records, "record", ["ord"], text="line").collect()}
    assert got == {"b": ("number", 0, 1), "a": ("object", 0, 2), "c": ("boolean", 1, 0), "z": ("string", 1, 1)}


def test_nothing_is_drawn_without_links(spark):
    from viewloom import GraphSpec
    from viewloom.operators import graph

    df = spark.createDataFrame([(0, "a", ["q"], 1.0), (1, "b", ["r"], 2.0)], "ord int, id string, l array<string>, v double")
    board = Dashboard(df, graph=GraphSpec("id", "l", "v", "ord"))
    nodes, found = graph.drawable(board.nodes, board.graph_links)
    assert board.nodes.count() == 2 and nodes.count() == 0 and found.count() == 0
