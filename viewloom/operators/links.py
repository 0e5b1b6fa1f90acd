"""Links between entities: mirrored counts, totals, and arcs on a circle.

Counts are kept once per unordered pair. Every ordered view is an expansion of that.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from viewloom.functions.columns import is_key, key_literal, key_text, order_key, short_label, type_of
from viewloom.operators.skew import is_small, lookup, numbered, sum_before
from viewloom.operators.staging import stored
from viewloom.plans.specs import LinkSpec
from viewloom.sources.records import in_order

PAD = 0.05  # radians left free between two entities' arcs


def tally(df: DataFrame, spec: LinkSpec) -> DataFrame:
    """All that the link view needs of the records, in one pass: a reduced, stored table.

    One row per unordered pair (a, b): the number of links in either direction (a link of
    an entity to itself counts twice), and the order at which each end was first the
    entity of a row, NULL if it never was. An entity without links has a row with itself
    and value 0. Missing entities and missing targets are left out.
    """
    common = spec.check(df)
    df = in_order(df, spec.order)
    linked = df.select(
        F.col(spec.entity).cast(common).alias("source"),
        order_key(df, spec.order).alias("ord"),
        F.explode_outer(spec.connections).alias("target"),
    ).select("source", "ord", F.col("target").cast(common).alias("target"))
    low, high = F.least("source", "target"), F.greatest("source", "target")
    weight = F.when(F.col("target").isNull(), 0).when(F.col("source") == F.col("target"), 2).otherwise(1)
    return stored(
        linked.where("source is not null")
        .groupBy(low.alias("a"), high.alias("b"))
        .agg(
            F.sum(weight).alias("value"),
            F.min(F.when(F.col("source") == low, F.col("ord"))).alias("a_seen"),
            F.min(F.when(F.col("source") == high, F.col("ord"))).alias("b_seen"),
        )
    )


def first_rows(df: DataFrame, spec: LinkSpec) -> DataFrame:
    """As `entities`, straight from the records: for when no links are asked for."""
    common = spec.check(df)
    df = in_order(df, spec.order)
    named = df.select(F.col(spec.entity).cast(common).alias("entity"), order_key(df, spec.order).alias("ord"))
    return named.where("entity is not null").groupBy("entity").agg(F.min("ord").alias("first_seen"))


def entities(tallied: DataFrame) -> DataFrame:
    """Each entity once, with the order of its first row."""
    ends = F.array(
        F.struct(F.col("a").alias("entity"), F.col("a_seen").alias("seen")),
        F.struct(F.col("b").alias("entity"), F.col("b_seen").alias("seen")),
    )
    return (
        tallied.select(F.explode(ends).alias("end"))
        .where("end.seen is not null")
        .groupBy(F.col("end.entity").alias("entity"))
        .agg(F.min("end.seen").alias("first_seen"))
    )


def indexed(known: DataFrame) -> DataFrame:
    """Entities numbered from 0 by first appearance."""
    return numbered(known, "first_seen").select("entity", "index")


def pairs(tallied: DataFrame, known: DataFrame) -> DataFrame:
    """Link counts per unordered pair (a, b) whose two ends are both entities.

    One end of a pair always is the entity of some row, so only the other is looked up;
    counting came first, so that join sees each pair once.
    """
    unsure = F.when(F.col("a_seen").isNotNull(), F.col("b")).otherwise(F.col("a"))
    linked = tallied.where("value > 0").withColumn("unsure", unsure)
    kept = lookup(linked, known.select("entity"), {"unsure": "entity"}, "left_semi", ["a", "b"])
    return kept.select("a", "b", "value")


def _both_ways(paired: DataFrame, a: str, b: str, carried: tuple[str, str] | None = None) -> DataFrame:
    """Each pair as (a, b) and (b, a); a pair of one entity with itself only once."""

    def end(first: str, second: str, seen: int) -> Column:
        extra = [F.col(carried[seen]).alias("target_seen")] if carried else []
        return F.struct(F.col(first).alias("source"), F.col(second).alias("target"), *extra)

    there, back = end(a, b, 1), end(b, a, 0)
    ends = F.when(F.col(a) == F.col(b), F.array(there)).otherwise(F.array(there, back))
    return paired.select(F.explode(ends).alias("end"), "value").select("end.*", "value")


def matrix(paired: DataFrame) -> DataFrame:
    """The symmetric link matrix as (source, target, value), without zero cells."""
    return _both_ways(paired, "a", "b")


def totals(paired: DataFrame, known: DataFrame) -> DataFrame:
    """Each entity's sum of links, and its share of all; 0 for an entity without links."""
    sums = matrix(paired).groupBy(F.col("source").alias("entity")).agg(F.sum("value").alias("links"))
    both_ends = F.when(F.col("a") == F.col("b"), F.col("value")).otherwise(F.col("value") * 2)
    everything = paired.agg(F.sum(both_ends)).scalar()
    total = F.coalesce(F.col("links"), F.lit(0))
    return known.join(sums, "entity", "left").select(
        "entity",
        "first_seen",
        total.alias("total"),
        F.coalesce(F.try_divide(total, everything), F.lit(0.0)).alias("share"),
    )


def arcs(paired: DataFrame, known: DataFrame, pad: float = PAD) -> DataFrame:
    """Each entity's arc: index, start and end in radians, in order of first appearance.

    Where the gaps alone would fill the circle, arcs have no length and gaps share it.
    """
    summed = stored(totals(paired, known))
    placed = sum_before(summed, "first_seen", {"index": F.lit(1), "before": F.col("total")})
    size = summed.agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("links"))
    n, links = size.select("n").scalar(), size.select("links").scalar()
    room = F.greatest(F.lit(0.0), F.lit(2 * math.pi) - F.lit(pad) * n)
    scale = F.coalesce(F.try_divide(room, links), F.lit(0.0))
    gap = F.when(F.lit(pad) * n < 2 * math.pi, F.lit(pad)).otherwise(F.lit(2 * math.pi) / n)
    start = F.col("before") * F.col("scale") + F.col("index") * F.col("gap")
    kind = type_of(known, "entity")
    return (
        placed.withColumn("scale", scale)
        .withColumn("gap", gap)
        .select(
            "entity",
            "index",
            "total",
            start.alias("start"),
            (start + F.col("total") * F.col("scale")).alias("end"),
            "scale",
            short_label(key_text(F.col("entity"), kind) if is_key(kind) else F.col("entity")).alias("label"),
        )
    )


def chords(tallied: DataFrame, known: DataFrame) -> DataFrame:
    """One (source, target, value) per pair of entities; the source is the one seen first."""
    linked = tallied.where("value > 0").select("a", "b", "value")
    seen = known.select("entity", "first_seen")
    seen_a, seen_b = (seen.withColumnRenamed("first_seen", name) for name in ("a_seen", "b_seen"))
    small, n_rows = is_small(seen), F.count(F.lit(1)).alias("n_rows")
    one = lookup(linked, seen_a, {"a": "entity"}, "inner", ["b"], small=small)
    # counted before the first join, which drops rows but adds none
    per_b = linked.groupBy("b").agg(n_rows)
    both = lookup(one, seen_b, {"b": "entity"}, "inner", ["a"], counts=per_b, small=small)
    forward = F.col("a_seen") <= F.col("b_seen")

    def pick(yes: str, no: str) -> Column:
        return F.when(forward, F.col(yes)).otherwise(F.col(no))

    return both.select(
        pick("a", "b").alias("source"),
        pick("b", "a").alias("target"),
        "value",
        pick("a_seen", "b_seen").alias("source_seen"),
        pick("b_seen", "a_seen").alias("target_seen"),
    )


def subarcs(ribboned: DataFrame) -> DataFrame:
    """The parts of each entity's arc, from `chords`: largest first, with links before it.

    Equal counts come in the order in which the targets were first seen.
    """
    ends = _both_ways(ribboned, "source", "target", ("source_seen", "target_seen"))
    ranked = stored(
        ends.select(
            "source",
            "target",
            "value",
            F.struct((-F.col("value")).alias("less"), F.col("target_seen")).alias("place"),
        )
    )
    sums = {"position": F.lit(1), "offset": F.col("value")}
    return sum_before(ranked, "place", sums, by=["source"]).drop("place")


def ribbons(ribboned: DataFrame, arced: DataFrame) -> DataFrame:
    """Both ends of each chord as angles: the parts from `subarcs` on the arcs from `arcs`.

    `ribboned` are the `chords`; pass them stored.
    """
    parts = _both_ways(ribboned, "source", "target").groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    base = arced.select("entity", F.col("start").alias("arc_start"), "scale", F.col("index").alias("at"))
    ends = lookup(subarcs(ribboned), base, {"source": "entity"}, "inner", ["target"], counts=parts)
    start = F.col("arc_start") + F.col("offset") * F.col("scale")
    cut = ends.select(
        F.least("source", "target").alias("a"),
        F.greatest("source", "target").alias("b"),
        "source",
        "value",
        "at",
        start.alias("start"),
        (start + F.col("value") * F.col("scale")).alias("end"),
    )
    # each pair has a row from either end (one if both are the same entity); the ends' numbers
    # and angles are of fixed width, so this stays a hash aggregate
    sides = [
        F.max(F.when(F.col("source") == F.col(side), F.col(c))).alias(f"{side}_{c}")
        for side in ("a", "b")
        for c in ("at", "start", "end")
    ]
    both = cut.groupBy("a", "b", "value").agg(*sides)
    forward = F.col("a_at") <= F.col("b_at")

    def pick(yes: str, no: str, name: str) -> Column:
        return F.when(forward, F.col(yes)).otherwise(F.col(no)).alias(name)

    return both.select(
        pick("a", "b", "source"),
        pick("b", "a", "target"),
        "value",
        pick("a_start", "b_start", "source_start"),
        pick("a_end", "b_end", "source_end"),
        pick("b_start", "a_start", "target_start"),
        pick("b_end", "a_end", "target_end"),
    )


def touching(linked: DataFrame, entity: object) -> DataFrame:
    """Links with the entity at either end."""
    one = key_literal(entity) if is_key(type_of(linked, "source")) else F.lit(entity)
    return linked.where((F.col("source") == one) | (F.col("target") == one))
