import pytest
from pyspark.sql.functions import array

from tests.frames import frame, graph_frame, link_frame, rows, series_frame, tree_frame
from viewloom import Dashboard, GraphSpec, HierarchySpec, LinkSpec, SeriesSpec
from viewloom.operators import graph, hierarchy, links, selection, series, skew
from viewloom.operators.staging import stored


def lit(df, *columns):
    return rows(df.where("lit"), *columns)


@pytest.fixture(scope="module")
def laid(spark):
    spec = HierarchySpec(["l1", "l2"], "v", "ord")
    return stored(hierarchy.layout(hierarchy.tree(hierarchy.leaves(tree_frame(spark), spec), 2), 2))


@pytest.fixture(scope="module")
def chords(spark):
    tally = links.tally(link_frame(spark), LinkSpec("c", "l", "ord"))
    return stored(links.chords(tally, links.entities(tally)))


def picked(spark, *values):
    return selection.keys(spark, values)


def test_add_remove_toggle_clear(spark):
    chosen = selection.add(picked(spark, "A"), picked(spark, "B", "A"))
    assert rows(chosen, "key") == [("A",), ("B",)]
    assert rows(selection.remove(chosen, picked(spark, "A", "Q")), "key") == [("B",)]
    assert rows(selection.toggle(chosen, picked(spark, "B", "C", "C")), "key") == [("A",), ("C",)]
    assert rows(selection.clear(chosen), "key") == []
    assert rows(selection.remove(selection.add(picked(spark), picked(spark, "A")), picked(spark, "A")), "key") == []


def test_series(spark):
    bars = series.rows(series_frame(spark), SeriesSpec("c", "v", "ord"))
    assert lit(selection.flag_series(bars, picked(spark, "A")), "ord") == [(0,), (2,)]
    assert len(lit(selection.flag_series(bars, picked(spark)), "ord")) == 4
    assert rows(selection.only(bars, ["category"], picked(spark, "B")), "ord") == [(1,)]
    assert selection.flag_series(bars, picked(spark, "A")).count() == 4


def test_entities_and_chords(spark, chords):
    known = links.entities(links.tally(link_frame(spark), LinkSpec("c", "l", "ord")))
    assert lit(selection.flag_entities(known, picked(spark, "A")), "entity") == [("A",)]
    assert lit(selection.flag_links(chords, picked(spark, "A")), "source", "target") == [("A", "B"), ("A", "C")]
    assert len(lit(selection.flag_links(chords, picked(spark)), "source")) == 4
    assert lit(selection.flag_links(chords, picked(spark, "nope")), "source") == []


def test_nodes_and_links(spark):
    spec, df = GraphSpec("id", "l", "v", "ord"), graph_frame(spark)
    assert lit(selection.flag_nodes(graph.nodes(df, spec), picked(spark, "c")), "id") == [("c",)]
    flagged = selection.flag_links(graph.links(df, spec), picked(spark, "c"), ["ord", "pos"])
    assert lit(flagged, "source", "target") == [("a", "c")]
    assert len(lit(selection.flag_links(graph.links(df, spec), picked(spark)), "source")) == 6


@pytest.mark.parametrize(
    "names, expected",
    [
        (["x"], ["", "/x", "A", "A/x", "B/A"]),
        (["A"], ["A", "B", "B/A"]),
        (["z"], ["B", "B/z"]),
        (["nope"], []),
        (["root"], []),
        ([], ["", "/x", "A", "A/x", "A/y", "B", "B/A", "B/w", "B/z"]),
    ],
)
def test_tree(spark, laid, names, expected):
    got = selection.flag_tree(laid, picked(spark, *names)).selectExpr("array_join(path, '/', '') p", "lit")
    assert lit(got, "p") == [(p,) for p in expected]


def test_first_node_with_a_name_is_the_first_of_its_ring(spark):
    # the first "k" of ring 2 lies under Q, which was seen first, though P/k has the earlier row
    data = [(0, "Q", "n", 1.0), (1, "P", "k", 1.0), (2, "Q", "k", 1.0), (3, "R", "P", 1.0), (4, "R", "Q", 1.0)]
    spec = HierarchySpec(["l1", "l2"], "v", "ord")
    df = frame(spark, data, "ord int, l1 string, l2 string, v double")
    laid = stored(hierarchy.layout(hierarchy.tree(hierarchy.leaves(df, spec), 2), 2))
    got = selection.flag_tree(laid, picked(spark, "k")).selectExpr("array_join(path, '/') p", "lit")
    assert lit(got, "p") == [("P",), ("P/k",), ("Q",), ("Q/k",), ("R/Q",)]


def test_keys_of_another_kind_never_match(spark):
    bars = series.rows(series_frame(spark), SeriesSpec("ord", "v", "ord"))
    assert lit(selection.flag_series(bars, picked(spark, "0")), "ord") == []
    assert lit(selection.flag_series(bars, selection.keys(spark, [2], "bigint")), "ord") == [(2,)]


def test_large_key_tables_are_not_broadcast(spark, monkeypatch, chords):
    monkeypatch.setattr(skew, "SMALL_ROWS", 0)
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 1)
    assert lit(selection.flag_links(chords, picked(spark, "A")), "source", "target") == [("A", "B"), ("A", "C")]


def test_key_dictionary(spark, laid):
    bars = series.summary(series.rows(series_frame(spark), SeriesSpec("c", "v", "ord")))
    known = links.entities(links.tally(link_frame(spark), LinkSpec("c", "l", "ord")))
    nodes = graph.nodes(graph_frame(spark), GraphSpec("id", "l", "v", "ord"))
    got = rows(selection.key_dictionary(bars, known, nodes, laid, groups=4), "index", "key", "group")
    # tree names ring by ring: A, B, (null), then x, y, A, z, w, x
    expected = ["A", "B", "C", "D", "a", "b", "", "c", "x", "y", "z", "w"]
    order = [k for _, k, _ in got]
    assert order[:8] == expected[:8] and set(order[8:]) == set(expected[8:])
    assert order[8:] == ["x", "y", "z", "w"]
    assert [g for _, _, g in got] == [i % 4 for i in range(12)]


def numbered_tree(spark):
    """Years as numbers above, texts that look like years below."""
    data = [(0, 2020, "a", 1.0), (1, 2021, "2020", 2.0), (2, 2022, "b", 1.0), (3, 2020, "b", 5.0)]
    df = frame(spark, data, "ord int, yr bigint, t string, v double")
    spec = HierarchySpec(["yr", "t"], "v", "ord")
    return df, spec, stored(hierarchy.layout(hierarchy.tree(hierarchy.leaves(df, spec), 2, hierarchy.kinds(df, spec)), 2))


@pytest.mark.parametrize("key_type", ["int", "bigint", "double", "decimal(10,2)"])
def test_numbers_light_number_levels(spark, key_type):
    df, _, laid = numbered_tree(spark)
    by_number = selection.flag_tree(laid, selection.keys(spark, [2020], key_type))
    assert lit(by_number.selectExpr("array_join(path, '/') p", "lit"), "p") == [("2020",)]
    bars = series.rows(df, SeriesSpec("yr", "v", "ord"))
    assert lit(selection.flag_series(bars, selection.keys(spark, [2020], key_type)), "ord") == [(0,), (3,)]


def test_texts_light_text_levels(spark):
    df, _, laid = numbered_tree(spark)
    by_text = selection.flag_tree(laid, picked(spark, "2020")).selectExpr("array_join(path, '/') p", "lit")
    assert lit(by_text, "p") == [("2021",), ("2021/2020",)]
    assert lit(selection.flag_series(series.rows(df, SeriesSpec("yr", "v", "ord")), picked(spark, "2020")), "ord") == []


def test_dictionary_tells_kinds_apart(spark):
    df, _, laid = numbered_tree(spark)
    bars = series.summary(series.rows(df, SeriesSpec("yr", "v", "ord")))
    texts = frame(spark, [("2021", "2024-01-01"), ("x", "2024-01-02")], "entity string, first_seen string")
    got = rows(selection.key_dictionary(bars, texts, None, laid), "index", "key", "kind")
    assert got == [(0, "2020", "number"), (1, "2021", "number"), (2, "2022", "number"), (3, "2021", "text"),
                   (4, "x", "text"), (5, "a", "text"), (6, "b", "text"), (7, "2020", "text")]


def test_keys_are_counted_once_for_all_views(spark, monkeypatch):
    df, spec, _ = numbered_tree(spark)
    board = Dashboard(df.withColumn("l", array("yr")), series=SeriesSpec("yr", "v", "ord"), hierarchy=spec,
                      links=LinkSpec("yr", "l", "ord"), graph=GraphSpec("yr", "l", "v", "ord"))
    looked = []
    monkeypatch.setattr(selection, "is_small", lambda df: looked.append(df) or True)
    views = board.select(selection.keys(spark, [2020, 2022], "bigint"))
    assert len(looked) == 1
    assert {v: f.where("lit").count() for v, f in views.items()} == {
        "series": 3, "entities": 2, "chords": 2, "nodes": 2, "links": 3, "tree": 2}
