"""Category/value series, and its layout on a circle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from viewloom.functions.columns import area_true, entry_sum, measure, order_key, type_of, without_nan
from viewloom.operators.skew import lookup, numbered
from viewloom.operators.staging import stored
from viewloom.plans.specs import SeriesSpec
from viewloom.sources.records import in_order

PADDING = 0.1  # share of a step left free between bands


def rows(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One (ord, category, value) per record. Nothing is grouped; a missing value stays missing."""
    spec.check(df)
    df = in_order(df, spec.order)
    if spec.measure.agg == "entry_sum":
        value = entry_sum(df, spec.measure.field)
    else:
        value, _ = measure(df, spec.measure.field)
    return df.select(
        order_key(df, spec.order).alias("ord"), F.col(spec.category).alias("category"), value.alias("value")
    )


def summary(series: DataFrame) -> DataFrame:
    """Each category once: order of its first row, greatest value, number of rows.

    One pass over the rows, stored; the rest of the view is laid out from it. The greatest
    value is also what is seen of a band when its bars lie over one another.
    """
    value = without_nan(F.col("value"), type_of(series, "value"))
    return stored(
        series.groupBy("category").agg(
            F.min("ord").alias("first_seen"),
            F.max(value).alias("value"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )


def largest(summed: DataFrame) -> DataFrame:
    """The greatest value of all rows, NaN left out."""
    return summed.agg(F.max("value").alias("largest"))


def bands(summed: DataFrame) -> DataFrame:
    """Where each category's band starts on the circle, and how wide it is, in radians."""
    count = summed.agg(F.count(F.lit(1))).scalar()
    step = F.lit(2 * math.pi) / (count + PADDING)
    return numbered(summed, "first_seen").select(
        "category",
        "index",
        (step * (F.col("index") + PADDING)).alias("start"),
        (step * (1 - PADDING)).alias("width"),
    )


def lengths(series: DataFrame, summed: DataFrame) -> DataFrame:
    """Bar length as a share of the radius, such that areas compare."""
    value = without_nan(F.col("value"), type_of(series, "value"))
    return series.withColumn("length", area_true(value, largest(summed).scalar()))


def overlay(summed: DataFrame) -> DataFrame:
    """The visible bar of each category: the longest of its bars."""
    return lengths(summed, summed).select("category", "value", "n_rows", "length")


def bars(series: DataFrame, summed: DataFrame) -> DataFrame:
    """Every row's bar: start and end angle, and length."""
    measured = lengths(series, summed)
    placed = lookup(measured, bands(summed), {"category": "category"}, "inner", ["ord"], counts=summed)
    end = F.col("start") + F.col("width")
    return placed.select("ord", "category", "value", "length", "start", end.alias("end"))
