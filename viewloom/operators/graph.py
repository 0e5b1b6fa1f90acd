"""Node/link graph: scaled nodes, directed links, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from viewloom.functions.columns import falsy, is_key, key_text, measure, number_text, or_zero, order_key, type_of
from viewloom.operators.links import touching
from viewloom.operators.skew import lookup, sum_before
from viewloom.operators.staging import stored
from viewloom.plans.specs import GraphSpec
from viewloom.sources.records import in_order


def nodes(df: DataFrame, spec: GraphSpec) -> DataFrame:
    """One node per id, with the strength of its first row scaled to a size.

    The range spans all rows, not only the first ones; it is folded per id on the way, so
    the input is read once. A flat range puts every node half way.
    """
    common = spec.check(df)
    df = in_order(df, spec.order)
    value, dtype = measure(df, spec.strength)
    reduced = stored(
        df.select(
            F.col(spec.node).cast(common).alias("id"),
            or_zero(value, dtype).alias("value"),
            order_key(df, spec.order).alias("ord"),
        )
        .groupBy("id")
        .agg(
            F.min_by("value", "ord").alias("value"),
            F.min("ord").alias("first_seen"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
    )
    low, high = reduced.agg(F.min("low")).scalar(), reduced.agg(F.max("high")).scalar()
    span = (high - low).cast("double")
    above = (F.col("value") - low).cast("double")
    norm = F.when(span > 0, F.try_divide(above, span)).otherwise(F.lit(0.5))
    return reduced.withColumn("norm", norm).select(
        "id",
        "value",
        "norm",
        (F.lit(spec.smallest) + F.col("norm") * (spec.largest - spec.smallest)).alias("size"),
        "first_seen",
    )


def links(
    df: DataFrame, spec: GraphSpec, node_rows: DataFrame | None = None, drop_falsy: bool = True
) -> DataFrame:
    """Directed links (ord, pos, source, target, value 1) between known nodes, repeats kept.

    By default a link with a falsy end (0, empty text, false, NaN) is dropped, as its node
    is not. Falsy ends go before the join. `node_rows` are the known nodes, if at hand.
    """
    common = spec.check(df)
    df = in_order(df, spec.order)
    listed = df.select(
        order_key(df, spec.order).alias("ord"),
        F.col(spec.node).cast(common).alias("source"),
        F.posexplode(spec.links).alias("pos", "target"),
    ).select("ord", "pos", "source", F.col("target").cast(common).alias("target"))
    if drop_falsy:
        listed = listed.where(~falsy(F.col("source"), common) & ~falsy(F.col("target"), common))
    if node_rows is None:
        node_rows = df.select(F.col(spec.node).cast(common).alias("id")).distinct()
    known = lookup(listed, node_rows.select("id"), {"target": "id"}, "left_semi", ["ord", "pos"])
    return known.withColumn("value", F.lit(1))


def drawable(node_rows: DataFrame, link_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph that lacks nodes or links shows nothing at all."""
    some_links = link_rows.select(F.lit(1)).limit(1).agg(F.count(F.lit(1))).scalar()
    some_nodes = node_rows.select(F.lit(1)).limit(1).agg(F.count(F.lit(1))).scalar()
    return node_rows.where(some_links > 0), link_rows.where(some_nodes > 0)


def neighbours(link_rows: DataFrame) -> DataFrame:
    """(node, neighbour) per link end, in either direction; a self-link gives the node once."""
    out = F.struct(F.col("source").alias("node"), F.col("target").alias("neighbour"))
    back = F.struct(F.col("target").alias("node"), F.col("source").alias("neighbour"))
    ends = F.when(F.col("source").eqNullSafe(F.col("target")), F.array(out)).otherwise(F.array(out, back))
    return link_rows.select("ord", "pos", F.explode(ends).alias("end")).select("ord", "pos", "end.*")


def neighbour_text(node_rows: DataFrame, link_rows: DataFrame, part_size: int = 1000) -> DataFrame:
    """Each node's strength and neighbours as text, in link order; `None` without neighbours.

    The list comes in parts of `part_size` names, numbered from 0, so that a hub needs no
    task to hold all of its links. Most nodes have part 0 only; read in order and joined
    with ", ", the parts are the whole text.
    """
    near = stored(
        neighbours(link_rows).select("node", "neighbour", F.struct("ord", "pos").alias("place"))
    )
    counted = sum_before(near, "place", {"rank": F.lit(1)}, by=["node"])
    kind = type_of(near, "neighbour")
    shown = key_text(F.col("neighbour"), kind) if is_key(kind) else F.col("neighbour").cast("string")
    named = F.struct("rank", shown.alias("name"))
    parts = (
        counted.withColumn("part", F.floor(F.col("rank") / part_size))
        .groupBy(F.col("node").alias("id"), "part")
        .agg(F.sort_array(F.collect_list(named)).alias("names"))
        .select("id", "part", F.array_join(F.col("names.name"), ", ", "").alias("text"))
    )
    linked = parts.where("part = 0").select(F.col("id").alias("_linked"))
    alone = node_rows.select("id").join(linked, F.col("id").eqNullSafe(F.col("_linked")), "left_anti")
    texts = parts.unionByName(
        alone.select("id", F.lit(0).cast("bigint").alias("part"), F.lit("None").alias("text"))
    )
    shown = node_rows.select("id", number_text(F.col("value")).alias("strength"))
    links_per_node = near.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    counts = links_per_node.select("id", F.ceil(F.col("n") / part_size).alias("n_rows"))
    named = lookup(texts, shown, {"id": "id"}, "inner", ["part"], counts=counts)
    return named.select("id", "part", "strength", "text")


def incident(link_rows: DataFrame, node: object) -> DataFrame:
    """Links with the node at either end."""
    return touching(link_rows, node)
