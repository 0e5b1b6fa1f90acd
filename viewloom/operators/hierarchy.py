"""Hierarchy over chosen levels: leaves, rollup, layout, labels, drill-down.

A node is named by its path, an array with one text per level. Arrays compare with NULL
elements as equal, so a missing name is a node of its own and joins like any other. Beside
it stand the kinds of the names (text, number, ...), one per level: 1 and "1" are two names.
On a level of mixed records kinds differ by row; there the path holds `kind:name`, and the
column `names` the names alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from viewloom.functions.columns import (
    coerced_measure, is_key, key_literal, key_text, kind_name, or_zero, order_key, path_text, type_of,
)
from viewloom.operators.skew import lookup, sum_before
from viewloom.operators.staging import stored
from viewloom.plans.specs import HierarchySpec
from viewloom.sources.records import in_order

ROOT = "root"
MIXED = "mixed"  # the kind of a level whose names have kinds of their own


def leaves(df: DataFrame, spec: HierarchySpec) -> DataFrame:
    """One (path, value, first_seen) per path; of several rows the last one gives the value."""
    spec.check(df)
    df = in_order(df, spec.order)
    value, dtype = coerced_measure(df, spec.value)
    names = [f"l{i}" for i in range(len(spec.levels))]
    grouped = (
        df.select(
            *[F.col(level).alias(n) for level, n in zip(spec.levels, names)],
            or_zero(value, dtype).alias("value"),
            order_key(df, spec.order).alias("ord"),
        )
        .groupBy(*names)
        .agg(F.max_by("value", "ord").alias("value"), F.min("ord").alias("first_seen"))
    )
    types = [type_of(df, level) for level in spec.levels]
    path = F.array(*[_step_text(F.col(n), t) for n, t in zip(names, types)])
    return grouped.select(path.alias("path"), "value", "first_seen")


def _step_text(name: Column, dtype: T.DataType) -> Column:
    return F.concat(name.getField("kind"), F.lit(":"), name.getField("value")) if is_key(dtype) else key_text(name, dtype)


def kinds(df: DataFrame, spec: HierarchySpec) -> list[str]:
    """The kind of the names on each level, from the schema."""
    types = [type_of(df, level) for level in spec.levels]
    return [MIXED if is_key(t) else kind_name(t) for t in types]


def tree(leaf_rows: DataFrame, depth: int, level_kinds: Sequence[str] | None = None) -> DataFrame:
    """Every node with its value rolled up from the leaves, the root (empty path) included.

    Children are counted by letting each node add one to its parent in the same grouping,
    so no node ever meets its children in one place. `level_kinds` are those of `kinds`; by
    default all names are text.
    """
    level_kinds = list(level_kinds or ["text"] * depth)
    step = [F.get("path", F.lit(i)) for i in range(depth)]
    of_mixed = lambda i: F.substring_index(step[i], ":", 1)
    bare = lambda i: F.substring(step[i], F.length(of_mixed(i)) + 2, F.length(step[i]))
    told = F.array(*[of_mixed(i) if k == MIXED else F.lit(k) for i, k in enumerate(level_kinds)])
    bared = F.array(*[bare(i) if k == MIXED else step[i] for i, k in enumerate(level_kinds)])
    names = [f"l{i}" for i in range(depth)]
    rolled = (
        leaf_rows.select(
            *[F.get("path", F.lit(i)).alias(n) for i, n in enumerate(names)], "value", "first_seen"
        )
        .rollup(*names)
        .agg(
            F.sum("value").alias("value"),
            F.min("first_seen").alias("first_seen"),
            (F.lit(depth) - F.bit_count(F.grouping_id())).alias("depth"),
        )
    )
    path = F.slice(F.array(*names), F.lit(1), F.col("depth"))
    paths = rolled.select(path.alias("path"), "value", "first_seen", "depth")
    value_type, seen_type = paths.schema["value"].dataType, paths.schema["first_seen"].dataType
    own = F.struct("path", "value", "first_seen", F.lit(0).cast("bigint").alias("child"))
    up = F.struct(
        F.slice("path", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))).alias("path"),
        F.lit(None).cast(value_type).alias("value"),
        F.lit(None).cast(seen_type).alias("first_seen"),
        F.lit(1).cast("bigint").alias("child"),
    )
    both = F.when(F.col("depth") > 0, F.array(own, up)).otherwise(F.array(own))
    whole = (
        paths.select(F.explode(both).alias("n"))
        .select("n.*")
        .groupBy("path")
        .agg(
            F.max("value").alias("value"),
            F.max("first_seen").alias("first_seen"),
            F.sum("child").alias("n_children"),
        )
    )
    size = F.size("path")
    parent = F.when(size > 0, F.slice("path", F.lit(1), F.greatest(size - 1, F.lit(0))))
    name = F.when(size > 0, F.get(bared, size - 1)).otherwise(F.lit(ROOT))
    bare_names = [F.slice(bared, F.lit(1), size).alias("names")] if MIXED in level_kinds else []
    return whole.select(
        "path",
        *bare_names,
        F.slice(told, F.lit(1), size).alias("kinds"),
        size.alias("depth"),
        name.alias("name"),
        parent.alias("parent"),
        "value",
        "first_seen",
        "n_children",
        (F.col("n_children") == 0).alias("is_leaf"),
    )


def slices(nodes: DataFrame) -> DataFrame:
    """The drawn nodes: all but the root."""
    return nodes.where("depth > 0")


def layout(nodes: DataFrame, depth: int, top: int = 0) -> DataFrame:
    """Partition layout of `tree`: angles in proportion to value, one ring per depth.

    Siblings follow one another in order of first appearance, inside their parent's angle.
    Children of a node of value 0 have no width. A node of negative value is drawn as the
    middle of its (backward) interval. `top` is the depth of the node drawn as the centre.
    `place` orders the nodes of one depth as they are laid out.

    Offsets among siblings are summed first; a node starts where the offsets of its path
    add up to. So all levels take one join, of nodes with the nodes on their paths, and one
    grouping. `nodes` is read several times: pass a stored frame.
    """
    root = nodes.where("depth = 0").select(F.sum("value").cast("double")).scalar()
    turn = F.coalesce(F.try_divide(F.lit(2 * math.pi), root), F.lit(0.0))
    parents = nodes.select(F.col("path").alias("parent"), F.col("n_children").alias("n_rows"))
    below_root = nodes.where("depth > 0").select("path", "parent", "value", "first_seen")
    siblings = stored(
        sum_before(below_root, "first_seen", {"offset": F.col("value")}, by=["parent"], counts=parents).select(
            F.col("path").alias("above"),
            F.col("offset").cast("double").alias("offset"),
            F.col("value").cast("double").alias("size"),
            F.col("first_seen").alias("seen"),
        )
    )
    steps = nodes.where("depth > 0").select("path", F.explode(F.sequence(F.lit(1), "depth")).alias("step"))
    steps = steps.withColumn("prefix", F.slice("path", F.lit(1), F.col("step")))
    met = lookup(steps, siblings, {"prefix": "above"}, "inner")
    along = F.sort_array(F.collect_list(F.struct("step", "offset", "size", "seen"))).alias("along")
    paths = met.groupBy("path").agg(along)

    # from the root down: where the node starts, and what an angle is worth there
    begun = F.struct(F.lit(0.0).alias("at"), F.lit(1.0).alias("worth"), F.lit(1.0).alias("below"))
    walked = F.aggregate(
        "along",
        begun,
        lambda now, node: F.struct(
            (now["at"] + node["offset"] * now["below"] * F.col("turn")).alias("at"),
            now["below"].alias("worth"),
            F.when(node["size"] == 0, F.lit(0.0)).otherwise(now["below"]).alias("below"),
        ),
    )
    places = paths.withColumn("turn", turn).select(
        F.col("path").alias("of"),
        walked.alias("walked"),
        F.col("turn"),
        F.transform("along", lambda node: node["seen"]).alias("place"),
    )
    no_place = F.array().cast(T.ArrayType(nodes.schema["first_seen"].dataType))
    top_node = nodes.where("depth = 0").select(
        *nodes.columns, F.lit(0.0).alias("raw0"), F.lit(2 * math.pi).alias("raw1"), no_place.alias("place")
    )
    start, width = F.col("walked.at"), F.col("value").cast("double") * F.col("walked.worth") * F.col("turn")
    placed = nodes.where("depth > 0").join(places, F.col("path") == F.col("of")).select(
        *nodes.columns, start.alias("raw0"), (start + width).alias("raw1"), "place"
    )
    everything = top_node.unionByName(placed)
    backward, middle = F.col("raw1") < F.col("raw0"), (F.col("raw0") + F.col("raw1")) / 2
    ring_count = F.lit(float(depth - top + 1))
    return everything.where(F.col("depth") >= top).select(
        *nodes.columns,
        F.when(backward, middle).otherwise(F.col("raw0")).alias("x0"),
        F.when(backward, middle).otherwise(F.col("raw1")).alias("x1"),
        ((F.col("depth") - top) / ring_count).alias("y0"),
        ((F.col("depth") - top + 1) / ring_count).alias("y1"),
        "place",
    )


def labels(nodes: DataFrame) -> DataFrame:
    """`root > A > B` and value per node."""
    return nodes.select("path", path_text(_names(nodes)).alias("label"), "value")


def _names(nodes: DataFrame) -> Column:
    return F.col("names" if "names" in nodes.columns else "path")


def ancestors(nodes: DataFrame) -> DataFrame:
    """The chain from the root down to each node: one (path, step, ancestor, name) per link."""
    chain = nodes.select("path", _names(nodes).alias("names"), F.explode(F.sequence(F.lit(0), F.size("path"))).alias("step"))
    name = F.when(F.col("step") > 0, F.get("names", F.col("step") - 1)).otherwise(F.lit(ROOT))
    return chain.select(
        "path", "step", F.slice("path", F.lit(1), F.col("step")).alias("ancestor"), name.alias("name")
    )


def below(df: DataFrame, spec: HierarchySpec, prefix: Sequence[object]) -> DataFrame:
    """Records under one node. A filter on the level columns, so it reaches the scan."""
    kept = df
    for level, name in zip(spec.levels, prefix):
        wanted = key_literal(name) if is_key(type_of(df, level)) else F.lit(name)
        kept = kept.where(F.col(level).isNull() if name is None else F.col(level) == wanted)
    return kept


def subtree(df: DataFrame, spec: HierarchySpec, prefix: Sequence[object]) -> DataFrame:
    """Drill-down: the node at `prefix` as centre and all below it, laid out anew.

    Records that were read with `numbered=False` get their order after the filter, which so
    reaches their scan too.
    """
    depth = len(spec.levels)
    if not 0 < len(prefix) <= depth:
        raise ValueError(f"prefix: one to {depth} names are needed")
    kept = below(df, spec, prefix)
    nodes = stored(tree(leaves(kept, spec), depth, kinds(kept, spec)))
    return layout(nodes, depth, top=len(prefix))


def intervals(nodes: DataFrame) -> DataFrame:
    """The nodes with `enter` and `leave`, numbers from 0 by which a node holds all nodes that lie below it.

    A node's interval is [enter, leave]: that of a node below lies inside, any other one apart. Siblings
    come in order of first appearance. `nodes` is `tree` or `layout`, stored; nothing is read but it.
    """
    sized = nodes.select("path", F.explode(F.sequence(F.lit(0), F.size("path"))).alias("n"))
    sized = sized.groupBy(F.slice("path", F.lit(1), F.col("n")).alias("path")).agg(F.count(F.lit(1)).alias("n_nodes"))
    own = nodes.select("path", "parent", "first_seen", "n_children")
    sized = stored(own.join(sized, "path"))
    parents = sized.select(F.col("path").alias("parent"), F.col("n_children").alias("n_rows"))
    ranked = sum_before(sized.where("parent IS NOT NULL").drop("n_children"), "first_seen", {"before": F.col("n_nodes")}, by=["parent"], counts=parents)
    ranked = stored(ranked.select(F.col("path").alias("above"), "before", "n_nodes"))
    steps = ranked.select("above", F.explode(F.sequence(F.lit(1), F.size("above"))).alias("n"))
    steps = steps.select(F.col("above").alias("path"), F.slice("above", F.lit(1), F.col("n")).alias("prefix"))
    met = lookup(steps, ranked.select("above", "before"), {"prefix": "above"}, "inner", spread=["path"])
    # each step down adds the node itself and what its earlier siblings hold
    entered = met.groupBy("path").agg(F.sum(F.col("before") + 1).alias("enter"))
    sizes = sized.select("path", "n_nodes")
    placed = sizes.join(entered, "path", "left").withColumn("enter", F.coalesce("enter", F.lit(0)).cast("bigint"))
    placed = placed.select(F.col("path").alias("of"), "enter", (F.col("enter") + F.col("n_nodes") - 1).alias("leave"))
    return nodes.join(placed, F.col("path") == F.col("of")).drop("of")


def path_key(prefix: Sequence[object], level_kinds: Sequence[str]) -> Column:
    """Names as the path that `tree` prints for them; None is a missing name."""
    steps = []
    for name, kind in zip(prefix, level_kinds):
        key = key_literal(name)
        text = F.concat(key["kind"], F.lit(":"), key["value"]) if kind == MIXED else key["value"]
        steps.append(F.lit(None).cast("string") if name is None else text)
    return F.array(*steps).cast("array<string>")


def _interval_of(nodes: DataFrame, path: Column) -> tuple[int, int] | None:
    found = nodes.where(F.col("path") == path).select("enter", "leave").first()
    return (found["enter"], found["leave"]) if found else None


def inside(nodes: DataFrame, path: Column) -> DataFrame:
    """A node and all below it: one range of `enter`, from nodes with `intervals`. Nothing for an unknown path."""
    interval = _interval_of(nodes, path)
    return nodes.where(F.col("enter").between(*interval)) if interval else nodes.where(F.lit(False))


def above(nodes: DataFrame, path: Column) -> DataFrame:
    """A node and all that hold it, the root included: those whose interval holds its number."""
    interval = _interval_of(nodes, path)
    if interval is None:
        return nodes.where(F.lit(False))
    return nodes.where((F.col("enter") <= interval[0]) & (F.col("leave") >= interval[0]))


def zoomed(nodes: DataFrame, path: Column, top: int, depth: int) -> DataFrame:
    """As `subtree`, from the stored tree with `intervals`; no record is read. `top` is the length of `path`."""
    below_it = inside(nodes, path)
    value = below_it.where(F.col("depth") == top).select("value").scalar()
    way = above(nodes, path).where(F.col("depth") < top)  # what leads there holds this node alone
    way = way.withColumns({"value": value.cast(nodes.schema["value"].dataType), "n_children": F.lit(1).cast("bigint")})
    return layout(stored(way.unionByName(below_it).drop("enter", "leave")), depth, top)


def holding(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """`nodes` (with `intervals`) with `holds`: whether the node or one below it is among `marked` (column enter).

    A running count over the numbers tells how many marked nodes lie before each; the count at the end of a
    node's interval less that at its begin is what it holds. So no node meets its ancestors.
    """
    marks = marked.select(F.col("enter").alias("_enter"), F.lit(1).alias("_mark")).distinct()
    counted = nodes.select("enter").join(marks, F.col("enter") == F.col("_enter"), "left")
    counted = stored(counted.select("enter", F.coalesce("_mark", F.lit(0)).alias("mark")))
    upto = stored(sum_before(counted, "enter", {"before": F.col("mark")}))
    first = upto.select(F.col("enter").alias("_first"), "before")
    last = upto.select(F.col("enter").alias("_last"), (F.col("before") + F.col("mark")).alias("through"))
    met = nodes.join(first, F.col("enter") == F.col("_first"))
    met = lookup(met, last, {"leave": "_last"}, "inner", spread=["enter"])
    return met.select(*nodes.columns, (F.col("through") > F.col("before")).alias("holds"))
