"""Records of mixed shape in all views, and number keys of all types, against plain values."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from viewloom import Dashboard, GraphSpec, HierarchySpec, LinkSpec, Measure, SeriesSpec
from viewloom.functions.columns import key_literal, key_text, plain_digits
from viewloom.operators import links, selection
from viewloom.sources.records import parse_variants

RECORDS = [
    {"ord": 0, "k": "3", "near": [3, "3", None, True], "v": 5, "o": {"a": 1, "b": 2.5, "c": "x"}, "l": [1]},
    {"ord": 1, "k": 3, "near": ["3", 3.0, {"x": 1}], "v": "7", "o": {}, "l": 2},
    {"ord": 2, "k": True, "near": [True, 0, ""], "v": None, "o": 4, "l": "x"},
    {"ord": 3, "k": None, "near": ["3"], "v": -5, "l": "x"},
    {"ord": 4, "near": "3", "v": 15, "l": None},
    {"ord": 5, "k": 3.0, "near": [], "v": 1e300, "it's": 1},
    {"ord": 6, "k": 0, "near": [3], "v": 2},
    {"ord": 7, "k": "", "near": [3], "v": 2},
    {"ord": 8, "k": [1], "near": [3], "v": 2},
]
SERIES = SeriesSpec("k", Measure("o", "entry_sum"), "ord")
LINKS = LinkSpec("k", "near", "ord")
GRAPH = GraphSpec("k", "near", "v", "ord")
TREE = HierarchySpec(["k", "l"], "v", "ord")


@pytest.fixture(scope="module")
def board(spark):
    lines = spark.createDataFrame([(r["ord"], json.dumps(r)) for r in RECORDS], "ord int, line string")
    return Dashboard.over_variants(parse_variants(lines, "line"), series=SERIES, links=LINKS, graph=GRAPH, hierarchy=TREE)


def shown(key):
    return None if key is None else (key["kind"], key["value"])


TEXT, THREE, YES = ("text", "3"), ("number", "3"), ("boolean", "true")


def test_series(board):
    got = {r.ord: (shown(r.category), r.value) for r in board.series_rows.collect()}
    assert got[0] == (TEXT, 3.5) and got[1] == (THREE, 0.0) and got[2] == (YES, None) and got[4] == (None, None)
    assert got[5][0] == THREE and got[8][0] is None


def test_links(board):
    got = {(shown(r.source), shown(r.target)): r.value for r in board.link_matrix().collect()}
    zero, empty = ("number", "0"), ("text", "")
    assert got[TEXT, THREE] == got[THREE, TEXT] == 2  # once from either
    assert got[TEXT, TEXT] == got[THREE, THREE] == got[YES, YES] == 2
    assert got[TEXT, YES] == 1 and got[YES, zero] == 1 and got[YES, empty] == 1 and got[zero, THREE] == 1 and got[empty, THREE] == 1
    arcs = {shown(r.entity): r.label for r in board.arcs().collect()}
    assert arcs[TEXT] == "3" and arcs[YES] == "true" and len(arcs) == 5
    touched = links.touching(board.link_matrix(), 3).collect()
    assert touched and all(THREE in (shown(r.source), shown(r.target)) for r in touched)


def test_graph(board):
    nodes = {shown(r.id): r.value for r in board.nodes.collect()}
    assert nodes[TEXT] == 5 and nodes[THREE] == 0 and nodes[YES] == 0 and nodes[None] == -5
    ends = [(shown(r.source), shown(r.target)) for r in board.graph_links.orderBy("ord", "pos").collect()]
    assert ends == [(TEXT, THREE), (TEXT, TEXT), (TEXT, YES), (THREE, TEXT), (THREE, THREE), (YES, YES)]


def test_tree(board):
    tree = {(*r.names, *r.kinds): r.value for r in board.tree.where("depth = 2").collect()}
    assert tree["3", None, "text", None] == 5 and tree["3", "2", "number", "number"] == 7 and tree["3", None, "number", None] == 1e300
    assert tree[None, "x", None, "text"] == -5 and tree["true", "x", "boolean", "text"] == 0
    below = board.zoom([3]).where("depth = 2").collect()
    assert {tuple(r.names) for r in below} == {("3", "2"), ("3", None)}
    drilled = board.drill([3]).where("depth = 2").collect()
    assert sorted(((r.path, r.x0, r.x1) for r in below), key=repr) == sorted(((r.path, r.x0, r.x1) for r in drilled), key=repr)


def test_selection(board, spark):
    for keys, lit in ((selection.keys(spark, [3], "int"), {1, 5}), (selection.keys(spark, ["3"]), {0}), (selection.keys(spark, [3.0], "double"), {1, 5})):
        views = board.select(keys)
        assert {r.ord for r in views["series"].where("lit").collect()} == lit
        assert {r.depth for r in views["tree"].where("lit").collect()} == {1, 2}
    mixed = spark.range(1).select(F.explode(F.array(key_literal(True), key_literal("3"))).alias("key"))
    views = board.select(mixed)
    assert {shown(r.id) for r in views["nodes"].where("lit").collect()} == {YES, TEXT}
    numbers = {(r.kind, r.key) for r in board.key_dictionary().collect()}
    assert {("text", "3"), ("number", "3"), ("boolean", "true"), ("number", "2"), ("text", "x")} <= numbers


DIGITS = {
    "1.0E15": "1000000000000000", "1.5E-5": "0.000015", "0.000015": "0.000015", "1.2345678912345E7": "12345678.912345", "-0.0": "0", "-2.50": "-2.5",
    "1E-18": "0.000000000000000001", "007": "7", "+5": "5", "1.0E300": "1" + "0" * 300, "NaN": "NaN", "Infinity": "Infinity", "0E-18": "0", "100": "100", "-1.0E-7": "-0.0000001",
}


def test_plain_digits(spark):
    rows = spark.createDataFrame(list(DIGITS.items()), "text string, want string")
    assert rows.select("text", "want", plain_digits(F.col("text")).alias("got")).where("got <> want").collect() == []


def test_numbers_of_all_types_print_alike(spark):
    for text in ("1000000000000000", "2020", "12345678", "0", "-7"):
        types = ["bigint", "double", "decimal(38,0)", "decimal(38,10)"]
        one = spark.range(1).select(*[key_text(F.lit(text).cast(t), T._parse_datatype_string(t)).alias(f"c{i}") for i, t in enumerate(types)]).first()
        assert set(one) == {text}
    for text in ("0.000015", "1.5", "-0.25"):
        one = spark.range(1).select(*[key_text(F.lit(text).cast(t), T._parse_datatype_string(t)).alias(t[:3]) for t in ("double", "decimal(38,10)")]).first()
        assert set(one) == {text}
