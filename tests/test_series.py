import math

import pytest

from tests.frames import frame, rows, series_frame
from viewloom import Measure, SeriesSpec
from viewloom.operators import series
from viewloom.plans.specs import BindingError

SPEC = SeriesSpec("c", "v", "ord")


def board(df):
    rows_ = series.rows(df, SPEC)
    return rows_, series.summary(rows_)


def test_rows_are_not_grouped(spark):
    got = series.rows(series_frame(spark), SPEC)
    assert rows(got, "ord", "category", "value") == [(0, "A", 4.0), (1, "B", 16.0), (2, "A", 9.0), (3, "C", None)]


def test_entry_sum_of_maps(spark):
    got = series.rows(series_frame(spark), SeriesSpec("c", Measure("m", "entry_sum"), "ord"))
    assert rows(got, "ord", "value") == [(0, 3.5), (1, 0.0), (2, 0.0), (3, None)]


def test_entry_sum_of_structs(spark):
    data = [(0, "A", {"x": 1, "y": 2.5}), (1, "B", {"x": None, "y": 1.0}), (2, "C", None)]
    df = frame(spark, data, "ord int, c string, s struct<x:int,y:double>")
    got = series.rows(df, SeriesSpec("c", Measure("s", "entry_sum"), "ord"))
    assert rows(got, "ord", "value") == [(0, 3.5), (1, 1.0), (2, None)]


def test_largest_passes_over_nan(spark):
    df = frame(spark, [(0, "A", float("nan")), (1, "B", 3.0)], "ord int, c string, v double")
    assert rows(series.largest(board(df)[1]), "largest") == [(3.0,)]


def test_bands(spark):
    got = rows(series.bands(board(series_frame(spark))[1]), "category", "index", "start", "width")
    assert [(c, i, round(s, 4), round(w, 4)) for c, i, s, w in got] == [
        ("A", 0, 0.2027, 1.8242), ("B", 1, 2.2295, 1.8242), ("C", 2, 4.2564, 1.8242),
    ]


def test_lengths_are_true_to_area(spark):
    got = series.lengths(*board(series_frame(spark)))
    assert rows(got, "ord", "length") == [(0, 0.5), (1, 1.0), (2, 0.75), (3, None)]


@pytest.mark.parametrize(
    "values, expected",
    [
        ([0.0, 0.0], [math.sqrt(0.5), math.sqrt(0.5)]),
        ([-4.0, 16.0], [-0.5, 1.0]),
        ([-4.0, -16.0], [1.0, 2.0]),
        ([None, None], [None, None]),
        ([float("nan"), 4.0], [None, 1.0]),
    ],
)
def test_length_edges(spark, values, expected):
    df = frame(spark, [(i, "A", v) for i, v in enumerate(values)], "ord int, c string, v double")
    got = [v for _, v in rows(series.lengths(*board(df)), "ord", "length")]
    assert got == pytest.approx(expected)


def test_overlay_shows_the_longest(spark):
    got = series.overlay(board(series_frame(spark))[1])
    assert rows(got, "category", "value", "n_rows", "length") == [
        ("A", 9.0, 2, 0.75), ("B", 16.0, 1, 1.0), ("C", None, 1, None),
    ]


def test_bars_one_per_row_and_null_category_has_a_band(spark):
    df = frame(spark, [(0, None, 4.0), (1, "B", 16.0), (2, None, 1.0)], "ord int, c string, v double")
    got = rows(series.bars(*board(df)), "ord", "category", "length", "start")
    step = 2 * math.pi / 2.1
    assert got == [(0, None, 0.5, pytest.approx(0.1 * step)), (1, "B", 1.0, pytest.approx(1.1 * step)),
                   (2, None, 0.25, pytest.approx(0.1 * step))]


def test_bindings_are_checked(spark):
    df = series_frame(spark)
    for bad in (SeriesSpec("m", "v", "ord"), SeriesSpec("c", "c", "ord"), SeriesSpec("c", "m", "ord"),
                SeriesSpec("c", Measure("v", "entry_sum"), "ord"), SeriesSpec("c", Measure("v", "avg"), "ord")):
        with pytest.raises(BindingError):
            bad.check(df)


def test_dotted_fields(spark):
    df = frame(spark, [(0, {"a": "X", "b": 2.0})], "ord int, s struct<a:string,b:double>")
    got = series.rows(df, SeriesSpec("s.a", "s.b", "ord"))
    assert rows(got, "category", "value") == [("X", 2.0)]
