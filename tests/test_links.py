import pytest

from tests.frames import frame, link_frame, rows
from viewloom import LinkSpec
from viewloom.operators import links
from viewloom.plans.specs import BindingError

SPEC = LinkSpec("c", "l", "ord")
MATRIX = [("A", "B", 2), ("A", "C", 1), ("B", "A", 2), ("B", "B", 2), ("B", "C", 1), ("C", "A", 1), ("C", "B", 1)]


def tallied(df, spec=SPEC):
    tally = links.tally(df, spec)
    known = links.entities(tally)
    return tally, links.pairs(tally, known), known


@pytest.fixture
def base(spark):
    return tallied(link_frame(spark))[1:]


@pytest.fixture
def ends(spark):
    tally, _, known = tallied(link_frame(spark))
    return tally, known


def test_entities_in_order_of_appearance(spark, base):
    assert rows(links.indexed(base[1]), "entity", "index") == [("A", 0), ("B", 1), ("C", 2), ("D", 3)]


def test_matrix_is_mirrored_and_self_links_count_twice(base):
    assert rows(links.matrix(base[0]), "source", "target", "value") == MATRIX


def test_entities_straight_from_the_records(spark, base):
    assert rows(links.first_rows(link_frame(spark), SPEC), "entity", "first_seen") == rows(base[1], "entity", "first_seen")


def test_totals_and_shares(base):
    got = rows(links.totals(*base), "entity", "total", "share")
    assert got == [("A", 3, 0.3), ("B", 5, 0.5), ("C", 2, 0.2), ("D", 0, 0.0)]


def test_arcs(base):
    got = {r["entity"]: (round(r["start"], 4), round(r["end"], 4)) for r in links.arcs(*base).collect()}
    assert got == {"A": (0, 1.8250), "B": (1.8750, 4.9165), "C": (4.9665, 6.1832), "D": (6.2332, 6.2332)}


def test_arcs_when_gaps_fill_the_circle(base):
    got = rows(links.arcs(*base, pad=2.0), "start", "end")
    assert [(round(a, 4), round(b, 4)) for a, b in got] == [(0, 0), (1.5708, 1.5708), (3.1416, 3.1416), (4.7124, 4.7124)]


def test_arcs_without_links(spark):
    df = frame(spark, [(0, "A", []), (1, "B", [])], "ord int, c string, l array<string>")
    got = rows(links.arcs(*tallied(df)[1:]), "entity", "start", "end")
    assert got == [("A", 0.0, 0.0), ("B", 0.05, 0.05)]


def test_chords_once_per_pair(ends):
    got = rows(links.chords(*ends), "source", "target", "value")
    assert got == [("A", "B", 2), ("A", "C", 1), ("B", "B", 2), ("B", "C", 1)]


def test_chord_source_is_the_entity_seen_first(spark):
    df = frame(spark, [(0, "Z", ["A"]), (1, "A", [])], "ord int, c string, l array<string>")
    tally, _, known = tallied(df)
    got = links.chords(tally, known)
    assert rows(got, "source", "target", "value") == [("Z", "A", 1)]


def test_subarcs_largest_first(ends):
    got = rows(links.subarcs(links.chords(*ends)), "source", "target", "value", "position", "offset")
    assert got == [
        ("A", "B", 2, 0, 0), ("A", "C", 1, 1, 2),
        ("B", "A", 2, 0, 0), ("B", "B", 2, 1, 2), ("B", "C", 1, 2, 4),
        ("C", "A", 1, 0, 0), ("C", "B", 1, 1, 1),
    ]


def test_ribbon_ends_lie_on_their_arcs(base, ends):
    arcs = links.arcs(*base)
    at = {r["entity"]: r for r in arcs.collect()}
    scale = at["A"]["scale"]
    got = {(r["source"], r["target"]): r for r in links.ribbons(links.chords(*ends), arcs).collect()}
    assert set(got) == {("A", "B"), ("A", "C"), ("B", "B"), ("B", "C")}
    assert got["A", "C"]["source_start"] == pytest.approx(at["A"]["start"] + 2 * scale)
    assert got["A", "C"]["target_start"] == pytest.approx(at["C"]["start"])
    assert got["B", "B"]["source_start"] == got["B", "B"]["target_start"]
    assert got["B", "C"]["target_end"] == pytest.approx(at["C"]["end"])


def test_touching(ends):
    got = links.touching(links.chords(*ends), "A")
    assert rows(got, "source", "target") == [("A", "B"), ("A", "C")]


def test_missing_entities_are_left_out(spark):
    data = [(0, None, ["A"]), (1, "A", ["A", None])]
    df = frame(spark, data, "ord int, c string, l array<string>")
    assert rows(tallied(df)[2], "entity") == [("A",)]
    assert rows(links.matrix(tallied(df)[1]), "source", "target", "value") == [("A", "A", 2)]


def test_keys_of_different_number_types_compare(spark):
    df = frame(spark, [(0, 1, [2, 1]), (1, 2, [7])], "ord int, c int, l array<bigint>")
    assert rows(links.matrix(tallied(df)[1]), "source", "target", "value") == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_bindings_are_checked(spark):
    df = link_frame(spark)
    for bad in (LinkSpec("l", "l", "ord"), LinkSpec("c", "c", "ord"), LinkSpec("ord", "l", "ord"), LinkSpec("c", "l", [])):
        with pytest.raises(BindingError):
            bad.check(df)


def test_row_placement_does_not_matter(spark):
    df = link_frame(spark).repartition(3).sortWithinPartitions("ord", ascending=False)
    assert rows(links.matrix(tallied(df)[1]), "source", "target", "value") == MATRIX
