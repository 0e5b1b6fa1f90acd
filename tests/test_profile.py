import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tests.frames import F5, frame, rows
from viewloom import GraphSpec, HierarchySpec, LinkSpec
from viewloom.functions.columns import order_key
from viewloom.operators import graph, hierarchy, links, profile
from viewloom.sources.records import BAD_RECORD, in_order, parse_variants, read_records, read_variants, with_row_order

SAMPLE = [
    {"team": "north", "points": 8, "rivals": ["south", "east"], "players": ["p1", "p7"], "home": {"city": "Riga", "hall": "blue"}},
    {"team": "south", "points": 3, "rivals": ["north", "west"], "players": ["p2"], "home": {"city": "Oslo", "hall": "red"}},
]


@pytest.fixture
def sample(spark, tmp_path):
    (tmp_path / "sample.json").write_text(json.dumps(SAMPLE, indent=1))
    return read_records(spark, str(tmp_path / "sample.json"))


def test_sample_file_end_to_end(sample):
    assert sample.count() == 2
    got = rows(profile.typed_profile(sample, ["row_order"]), "key", "kind", "is_numeric")
    assert got == [("home", "object", False), ("players", "array", False), ("points", "number", True),
                   ("rivals", "array", False), ("team", "string", False)]
    spec = LinkSpec("team", "rivals", "row_order")
    tally = links.tally(sample, spec)
    assert rows(links.matrix(links.pairs(tally, links.entities(tally))), "source", "target", "value") == [("north", "south", 2), ("south", "north", 2)]
    spec = GraphSpec("team", "rivals", "points", "row_order")
    assert rows(graph.nodes(sample, spec), "id", "size") == [("north", 30.0), ("south", 10.0)]
    assert rows(graph.links(sample, spec), "source", "target") == [("north", "south"), ("south", "north")]
    spec = HierarchySpec(["home.city", "home.hall"], "points", "row_order")
    assert rows(hierarchy.leaves(sample, spec), "path", "value") == [(["Oslo", "red"], 3), (["Riga", "blue"], 8)]


def test_one_object_is_one_record(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(SAMPLE[0]))
    assert rows(read_records(spark, str(tmp_path / "one.json")), "team") == [("north",)]


def test_cut_file_is_refused(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps(SAMPLE)[:-30])
    with pytest.raises((PySparkException, Py4JJavaError), match="[Mm]alformed"):
        read_records(spark, str(tmp_path / "cut.json"), schema="team string, points bigint").collect()


def test_bad_lines_can_be_kept(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    df = read_records(spark, str(tmp_path / "l.json"), lines=True, schema="a int", keep_bad=True)
    got = [(r["a"], r[BAD_RECORD]) for r in df.orderBy("row_order").collect()]
    assert got == [(1, None), (None, '{"a": '), (3, None)]


def test_row_order_is_file_order(spark, tmp_path):
    text = "".join(json.dumps({"i": i}) + "\n" for i in range(3000))
    (tmp_path / "many.json").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_records(spark, str(tmp_path / "many.json"), lines=True, schema="i int")
        assert df.rdd.getNumPartitions() > 1
        assert [r["i"] for r in df.orderBy("row_order").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_row_order_over_files_and_filters(spark, tmp_path):
    """Files count by path, also one with a space; filters taken before or after the numbering change no order."""
    folder = tmp_path / "many files"
    folder.mkdir()
    for f, name in enumerate(["a.json", "b c.json", "d.json"]):
        (folder / name).write_text("".join(json.dumps({"i": f * 100 + i}) + "\n" for i in range(100)))
    for numbered in (True, False):
        df = read_records(spark, str(folder), lines=True, schema="i int", numbered=numbered)
        kept = with_row_order(df.where("i % 2 = 0"))
        assert kept.schema["row_order"].dataType.simpleString() == "decimal(38,0)"
        got = kept.orderBy("row_order").collect()
        assert [r["i"] for r in got] == list(range(0, 300, 2)) and len({r["row_order"] for r in got}) == 150


def test_drill_down_filters_below_the_order(spark, tmp_path):
    text = "".join(json.dumps({"g": "xy"[i % 2], "v": i}) + "\n" for i in range(10))
    (tmp_path / "r.json").write_text(text)
    df = read_records(spark, str(tmp_path / "r.json"), lines=True, schema="g string, v bigint", numbered=False)
    spec = HierarchySpec(["g"], "v", "row_order")
    assert rows(hierarchy.subtree(df, spec, ["x"]), "path", "value") == [(["x"], 8.0)]
    kept = in_order(hierarchy.below(df, spec, ["x"]), spec.order)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("monotonically_increasing_id") < plan.index("Filter (isnotnull(g")
    assert "EqualTo(g,x)" in kept._jdf.queryExecution().executedPlan().toString()


def test_several_order_columns_are_packed(spark):
    rng = random.Random(5)
    some = lambda lo, hi: rng.choice([None, lo, hi, rng.randrange(lo, hi)])
    data = [(some(-(1 << 63), (1 << 63) - 1), some(-128, 127), rng.choice([None, True, False]), some(-(1 << 31), (1 << 31) - 1)) for _ in range(200)]
    df = frame(spark, data, "a bigint, b tinyint, c boolean, d int")
    packed = df.select("*", order_key(df, ["a", "b", "c", "d"]).alias("o"))
    assert packed.schema["o"].dataType.simpleString() == "decimal(38,0)"
    low = lambda r: tuple((v is not None, v or 0) for v in r)
    got = [low((r["a"], r["b"], r["c"], r["d"])) for r in packed.orderBy("o").collect()]
    assert got == sorted(got) and packed.select("o").distinct().count() == len(set(data))
    assert order_key(df, ["a", "b"]) is not None and "struct" in df.select(order_key(df, ["a", "a"]).alias("o")).schema["o"].dataType.simpleString()


def test_variant_profile_keeps_the_first_kind(spark):
    df = parse_variants(frame(spark, F5, "ord int, j string"), "j")
    got = rows(profile.variant_profile(df, "record", ["ord"]), "key", "kind", "is_numeric", "first_seen")
    assert got == [("a", "object", True, 0), ("b", "array", False, 1), ("c", "boolean", False, 1),
                   ("d", "number", True, 1), ("e", "object", True, 0)]


def test_variant_file(spark, tmp_path):
    records = [{"x": 1, "m": {"a": None}}, {"x": "s", "t": "2024-01-01"}, 5, [1], {"m": {"a": 1}, "n": None}]
    (tmp_path / "v.json").write_text("".join(json.dumps(r) + "\n" for r in records[:2] + records[4:]))
    df = read_variants(spark, str(tmp_path / "v.json"), lines=True)
    got = rows(profile.variant_profile(df, "record", ["row_order"]), "key", "kind", "is_numeric")
    assert got == [("m", "object", False), ("t", "string", False), ("x", "number", True)]
    (tmp_path / "w.json").write_text(json.dumps([records[0], records[1]]))
    assert read_variants(spark, str(tmp_path / "w.json")).count() == 2
    loose = parse_variants(frame(spark, [(i, json.dumps(r)) for i, r in enumerate(records)], "ord int, j string"), "j")
    assert rows(profile.variant_profile(loose, "record", ["ord"]), "key") == [("m",), ("t",), ("x",)]


def test_typed_profile_finds_the_first_presence(spark):
    df = frame(spark, [(0, None, 1, None), (1, "x", 2, None)], "ord int, a string, b int, c double")
    got = rows(profile.typed_profile(df, ["ord"]), "key", "first_seen", "position", "n_missing")
    assert got == [("a", 1, 1, 1), ("b", 0, 2, 0), ("ord", 0, 0, 0)]


def test_roles(spark):
    df = parse_variants(frame(spark, F5, "ord int, j string"), "j")
    roles = profile.roles(profile.variant_profile(df, "record", ["ord"]))
    assert rows(roles.where("view = 'series' and part = 'value'"), "label", "agg") == [
        ("Sum of a", "entry_sum"), ("Sum of e", "entry_sum"), ("d", "value")]
    assert rows(roles.where("view = 'links' and part = 'connections'"), "field") == [("b",)]
    assert rows(roles.where("view = 'graph' and part = 'strength'"), "field") == [("d",)]
    assert rows(roles.where("view = 'hierarchy' and part = 'level'"), "field") == [("c",), ("d",)]
    nodes = roles.where("view = 'graph' and part = 'node'")
    assert rows(nodes, "field", "bindable") == [("a", False), ("b", False), ("c", True), ("d", True), ("e", False)]
