import math

import pytest

from tests.frames import frame, rows, tree_frame
from viewloom import HierarchySpec
from viewloom.operators import hierarchy
from viewloom.operators.staging import stored
from viewloom.plans.specs import BindingError

SPEC = HierarchySpec(["l1", "l2"], "v", "ord")
ROOT, A, B, NONE = (), ("A",), ("B",), (None,)


def nodes(df, spec=SPEC):
    return stored(hierarchy.tree(hierarchy.leaves(df, spec), len(spec.levels)))


def by_path(df, *columns):
    return {tuple(r["path"]): tuple(r[c] for c in columns) for r in df.collect()}


@pytest.fixture
def tree(spark):
    return nodes(tree_frame(spark))


def test_last_row_gives_a_leaf_its_value(spark):
    got = by_path(hierarchy.leaves(tree_frame(spark), SPEC), "value", "first_seen")
    assert got == {("A", "x"): (2, 0), ("A", "y"): (3, 1), ("B", "A"): (4, 3), ("B", "z"): (0, 4),
                   (None, "x"): (1, 5), ("B", "w"): (1, 6)}


def test_rollup(tree):
    got = by_path(tree, "depth", "name", "value", "n_children", "is_leaf")
    assert got == {
        ROOT: (0, "root", 11, 3, False),
        A: (1, "A", 5, 2, False), B: (1, "B", 5, 3, False), NONE: (1, None, 1, 1, False),
        ("A", "x"): (2, "x", 2, 0, True), ("A", "y"): (2, "y", 3, 0, True),
        ("B", "A"): (2, "A", 4, 0, True), ("B", "z"): (2, "z", 0, 0, True),
        ("B", "w"): (2, "w", 1, 0, True), (None, "x"): (2, "x", 1, 0, True),
    }
    assert by_path(tree, "parent")[ROOT] == (None,) and by_path(tree, "parent")["B", "z"] == (["B"],)


def test_layout(tree):
    got = by_path(hierarchy.layout(tree, 2), "x0", "x1", "y0", "y1")
    share = {p: (round(a / 2 / math.pi, 4), round(b / 2 / math.pi, 4)) for p, (a, b, _, _) in got.items()}
    assert share == {
        ROOT: (0, 1), A: (0, 0.4545), B: (0.4545, 0.9091), NONE: (0.9091, 1),
        ("A", "x"): (0, 0.1818), ("A", "y"): (0.1818, 0.4545), ("B", "A"): (0.4545, 0.8182),
        ("B", "z"): (0.8182, 0.8182), ("B", "w"): (0.8182, 0.9091), (None, "x"): (0.9091, 1),
    }
    assert got[A][2:] == pytest.approx((1 / 3, 2 / 3)) and got["A", "x"][2:] == pytest.approx((2 / 3, 1))


def test_children_tile_their_parent(spark):
    data = [(i, f"g{i % 3}", f"s{i % 7}", f"t{i}", float(i % 11)) for i in range(60)]
    df = frame(spark, data, "ord int, a string, b string, c string, v double")
    spec = HierarchySpec(["a", "b", "c"], "v", "ord")
    laid = hierarchy.layout(nodes(df, spec), 3).collect()
    at = {tuple(r["path"]): r for r in laid}
    for path, r in at.items():
        children = sorted((c for p, c in at.items() if p[:-1] == path and len(p) == len(path) + 1), key=lambda c: c["first_seen"])
        if children:
            assert sum(c["value"] for c in children) == pytest.approx(r["value"])
            edge = r["x0"]
            for c in children:
                assert c["x0"] == pytest.approx(edge)
                edge = c["x1"]
            assert edge == pytest.approx(r["x1"])


def test_negative_and_cancelling_values(spark):
    data = [(0, "A", "x", 6.0), (1, "B", "y", 2.0), (2, "B", "z", -2.0), (3, "C", "w", -1.0), (4, "D", "v", 3.0)]
    got = by_path(hierarchy.layout(nodes(frame(spark, data, "ord int, l1 string, l2 string, v double")), 2), "x0", "x1")
    unit = 2 * math.pi / 8
    assert got[A] == pytest.approx((0, 6 * unit))
    assert got["B", "y"] == pytest.approx((6 * unit, 6 * unit))  # the parent sums to 0
    assert got["C",] == pytest.approx((5.5 * unit, 5.5 * unit))  # backward interval
    assert got["D", "v"] == pytest.approx((5 * unit, 8 * unit))


def test_all_zero(spark):
    df = frame(spark, [(0, "A", "x", 0.0), (1, "B", "y", None)], "ord int, l1 string, l2 string, v double")
    got = by_path(hierarchy.layout(nodes(df), 2), "x0", "x1")
    assert got[A] == (0, 0) and got["B", "y"] == (0, 0) and got[ROOT] == pytest.approx((0, 2 * math.pi))


def test_labels_print_missing_names_empty(tree):
    got = by_path(hierarchy.labels(tree), "label")
    assert got[ROOT] == ("root",) and got["B", "w"] == ("root > B > w",) and got[None, "x"] == ("root >  > x",)


def test_ancestors(tree):
    chain = hierarchy.ancestors(tree.where("array_join(path, '/') = 'B/w'"))
    assert rows(chain, "step", "name") == [(0, "root"), (1, "B"), (2, "w")]


def test_subtree_is_laid_out_anew(spark):
    got = by_path(hierarchy.subtree(tree_frame(spark), SPEC, ["B"]), "value", "x0", "x1", "y0")
    assert {p: v[0] for p, v in got.items()} == {B: 5, ("B", "A"): 4, ("B", "z"): 0, ("B", "w"): 1}
    assert got[B][1:] == pytest.approx((0, 2 * math.pi, 0))
    assert got["B", "w"][1:] == pytest.approx((0.8 * 2 * math.pi, 2 * math.pi, 0.5))
    missing = by_path(hierarchy.subtree(tree_frame(spark), SPEC, [None]), "value")
    assert missing == {NONE: (1,), (None, "x"): (1,)}


def test_text_sizes_are_coerced(spark):
    data = [(0, "A", " 12 "), (1, "B", "3e1"), (2, "C", "n/a"), (3, "D", ""), (4, "E", "1d")]
    df = frame(spark, data, "ord int, l1 string, v string")
    got = by_path(nodes(df, HierarchySpec(["l1"], "v", "ord")), "value")
    assert got == {ROOT: (42,), A: (12,), B: (30,), ("C",): (0,), ("D",): (0,), ("E",): (0,)}


def test_one_field_may_serve_two_levels(spark):
    got = by_path(nodes(tree_frame(spark), HierarchySpec(["l2", "l2"], "v", "ord")), "value")
    assert got["x", "x"] == (1,) and got["x",] == (1,)


def test_bindings_are_checked(spark):
    df = frame(spark, [(0, "A", [1], True)], "ord int, l1 string, l array<int>, b boolean")
    for bad in (HierarchySpec([], "ord", "ord"), HierarchySpec(["l"], "ord", "ord"), HierarchySpec(["l1"], "b", "ord")):
        with pytest.raises(BindingError):
            bad.check(df)
