from collections import Counter
from decimal import Decimal

import pytest

from tests.frames import frame, graph_frame, rows
from viewloom import GraphSpec
from viewloom.operators import graph
from viewloom.plans.specs import BindingError

SPEC = GraphSpec("id", "l", "v", "ord")
SCHEMA = "ord int, id string, v double, l array<string>"


def test_nodes_take_their_first_row_and_the_range_of_all(spark):
    got = rows(graph.nodes(graph_frame(spark), SPEC), "id", "value", "size")
    assert [(i, v, round(s, 4)) for i, v, s in got] == [
        ("", -10.0, 10.0), ("a", 10.0, 13.6697), ("b", 0.0, 11.8349), ("c", 30.0, 17.3394),
    ]


def test_flat_range_puts_nodes_half_way(spark):
    df = frame(spark, [(0, "a", 7.0, []), (1, "b", 7.0, [])], SCHEMA)
    assert rows(graph.nodes(df, SPEC), "norm", "size") == [(0.5, 20.0), (0.5, 20.0)]


def test_links_are_directed_repeated_and_never_falsy(spark):
    got = rows(graph.links(graph_frame(spark), SPEC), "ord", "pos", "source", "target", "value")
    assert got == [
        (0, 0, "a", "b", 1), (0, 1, "a", "c", 1), (0, 2, "a", "b", 1),
        (1, 0, "b", "a", 1), (1, 1, "b", "b", 1), (2, 0, "a", "b", 1),
    ]
    kept = rows(graph.links(graph_frame(spark), SPEC, drop_falsy=False), "source", "target")
    assert ("", "a") in kept and ("c", "") in kept and ("c", "q") not in kept


def test_key_zero_is_falsy(spark):
    df = frame(spark, [(0, 0, 1.0, [1]), (1, 1, 1.0, [0, 1])], "ord int, id bigint, v double, l array<int>")
    assert rows(graph.links(df, SPEC), "source", "target") == [(1, 1)]
    assert rows(graph.nodes(df, SPEC), "id") == [(0,), (1,)]


def test_neighbours_in_both_directions(spark):
    near = graph.neighbours(graph.links(graph_frame(spark), SPEC))
    bags = {}
    for node, other in rows(near, "node", "neighbour"):
        bags.setdefault(node, []).append(other)
    assert bags == {"a": ["b", "b", "b", "b", "c"], "b": ["a", "a", "a", "a", "b"], "c": ["a"]}


def test_neighbour_text_in_link_order(spark):
    df = graph_frame(spark)
    nodes, links = graph.nodes(df, SPEC), graph.links(df, SPEC)
    got = rows(graph.neighbour_text(nodes, links), "id", "part", "strength", "text")
    assert got == [
        ("", 0, "-10", "None"), ("a", 0, "10", "b, c, b, b, b"), ("b", 0, "0", "a, a, a, b, a"), ("c", 0, "30", "a"),
    ]
    parts = rows(graph.neighbour_text(nodes, links, part_size=2), "id", "part", "text")
    assert [p for p in parts if p[0] == "a"] == [("a", 0, "b, c"), ("a", 1, "b, b"), ("a", 2, "b")]


def test_incident_links(spark):
    got = graph.incident(graph.links(graph_frame(spark), SPEC), "c")
    assert rows(got, "source", "target") == [("a", "c")]


def test_graph_without_links_or_nodes_shows_nothing(spark):
    for data in ([(0, "a", 1.0, None), (1, "b", 2.0, ["zz"])], []):
        df = frame(spark, data, SCHEMA)
        nodes, links = graph.drawable(graph.nodes(df, SPEC), graph.links(df, SPEC))
        assert nodes.count() == 0 and links.count() == 0
    df = graph_frame(spark)
    nodes, links = graph.drawable(graph.nodes(df, SPEC), graph.links(df, SPEC))
    assert nodes.count() == 4 and links.count() == 6


def test_links_end_at_nodes_and_norm_is_a_share(spark):
    df = graph_frame(spark)
    nodes = graph.nodes(df, SPEC)
    ids = {i for i, in rows(nodes, "id")}
    assert all(a in ids and b in ids for a, b in rows(graph.links(df, SPEC), "source", "target"))
    assert all(0 <= n <= 1 for n, in rows(nodes, "norm"))


def test_bindings_are_checked(spark):
    df = graph_frame(spark)
    for bad in (GraphSpec("l", "l", "v", "ord"), GraphSpec("id", "v", "v", "ord"), GraphSpec("id", "l", "id", "ord")):
        with pytest.raises(BindingError):
            bad.check(df)


def test_a_null_node_has_its_links_and_its_text_once(spark):
    data = [(0, None, 1.0, [None, "a"]), (1, "a", 2.0, ["b"])]
    df = frame(spark, data, "ord int, id string, v double, l array<string>")
    spec = GraphSpec("id", "l", "v", "ord")
    nodes, links = graph.nodes(df, spec), graph.links(df, spec, drop_falsy=False)
    assert rows(links, "source", "target") == [(None, None), (None, "a")]
    near = Counter((r["node"], r["neighbour"]) for r in graph.neighbours(links).collect())
    assert near == {(None, None): 1, (None, "a"): 1, ("a", None): 1}
    got = {r["id"]: r["text"] for r in graph.neighbour_text(nodes, links).collect()}
    assert graph.neighbour_text(nodes, links).count() == 2 and got[None] == ", a" and got["a"] == ""


def test_long_decimal_ids_stay_apart(spark):
    ids = [9007199254740993, 9007199254740992]
    df = frame(spark, [(i, n, 1.0, [Decimal(n)]) for i, n in enumerate(ids)], "ord int, id bigint, v double, l array<decimal(20,0)>")
    spec = GraphSpec("id", "l", "v", "ord")
    assert graph.nodes(df, spec).count() == 2
    assert rows(graph.links(df, spec), "source", "target") == [(Decimal(n), Decimal(n)) for n in sorted(ids)]
    wide = frame(spark, [], "ord int, id bigint, v double, l array<decimal(38,30)>")
    with pytest.raises(BindingError):
        spec.check(wide)


@pytest.mark.parametrize("value, shown", [(0.0625, "0.063"), (0.0624, "0.062"), (-2.5005, "-2.501"), (1234567.0, "1,234,567"), (12.5, "12.5")])
def test_number_text_rounds_halves_up(spark, value, shown):
    df = frame(spark, [(0, "a", value, ["a"])], "ord int, id string, v double, l array<string>")
    spec = GraphSpec("id", "l", "v", "ord")
    assert rows(graph.neighbour_text(graph.nodes(df, spec), graph.links(df, spec)), "strength") == [(shown,)]
