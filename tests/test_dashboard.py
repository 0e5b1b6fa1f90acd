import pytest

from tests.frames import frame, rows
from viewloom import Dashboard, GraphSpec, HierarchySpec, LinkSpec, SeriesSpec
from viewloom.operators import selection
from viewloom.plans.specs import BindingError

DATA = [
    (0, "A", "g", 4.0, ["B", "B"]),
    (1, "B", "g", 16.0, ["A"]),
    (2, "A", "h", 9.0, ["C"]),
]


@pytest.fixture(scope="module")
def board(spark):
    df = frame(spark, DATA, "ord int, c string, g string, v double, l array<string>")
    return Dashboard(
        df,
        series=SeriesSpec("c", "v", "ord"),
        links=LinkSpec("c", "l", "ord"),
        graph=GraphSpec("c", "l", "v", "ord"),
        hierarchy=HierarchySpec(["g", "c"], "v", "ord"),
    )


def test_one_selection_lights_all_views(spark, board):
    views = board.select(selection.keys(spark, ["A"]))
    assert rows(views["series"].where("lit"), "ord") == [(0,), (2,)]
    assert rows(views["entities"].where("lit"), "entity") == [("A",)]
    assert rows(views["chords"].where("lit"), "source", "target", "value") == [("A", "B", 3)]
    assert rows(views["nodes"].where("lit"), "id") == [("A",)]
    assert rows(views["links"].where("lit"), "source", "target") == [("A", "B"), ("A", "B"), ("B", "A")]
    lit = views["tree"].where("lit").selectExpr("array_join(path, '/') p")
    assert rows(lit, "p") == [("g",), ("g/A",), ("h",), ("h/A",)]


def test_views(board):
    assert rows(board.link_matrix(), "source", "target", "value") == [("A", "B", 3), ("B", "A", 3)]
    assert rows(board.bars(), "ord", "length") == [(0, 0.5), (1, 1.0), (2, 0.75)]
    assert rows(board.visible_bars(), "category", "value") == [("A", 9.0), ("B", 16.0)]
    assert rows(board.ribbons(), "source", "target") == [("A", "B")]
    assert board.neighbours().count() == 6
    assert board.slices().count() == 5
    assert board.drill(["h"]).count() == 2
    assert rows(board.key_dictionary(), "index", "key") == [(0, "A"), (1, "B"), (2, "g"), (3, "h")]


def test_symmetry_and_totals(board):
    cells = {(a, b): v for a, b, v in rows(board.link_matrix(), "source", "target", "value")}
    assert all(cells[b, a] == v for (a, b), v in cells.items())
    assert sum(t for _, t in rows(board.arcs(), "entity", "total")) == sum(cells.values()) == 2 * 3


def test_unbound_and_wrong_views(spark, board):
    with pytest.raises(BindingError):
        Dashboard(board.df, series=SeriesSpec("l", "v", "ord"))
    with pytest.raises(ValueError):
        Dashboard(board.df).bars()
