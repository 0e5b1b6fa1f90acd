"""One shared set of selected keys, and what it lights up in each view.

An empty selection lights everything. Keys are equal if they are equal in kind and in value:
the number 2020 lights the number 2020, in whichever number type, and never the text "2020".
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from viewloom.functions.columns import is_key, key_kind, key_of, key_text, kind_name, shared_type, type_of
from viewloom.operators.hierarchy import ROOT, holding
from viewloom.operators.skew import is_small, lookup, numbered
from viewloom.operators.staging import stored


def keys(spark: SparkSession, values: Iterable[object], key_type: str = "string") -> DataFrame:
    """A key table of the given values, held by the JVM as a local relation."""
    return spark.createDataFrame(pa.table({"key": list(values)})).select(F.col("key").cast(key_type))


def add(selected: DataFrame, more: DataFrame) -> DataFrame:
    return selected.select("key").union(more.select("key")).distinct()


def remove(selected: DataFrame, gone: DataFrame) -> DataFrame:
    return selected.select("key").distinct().join(gone.select("key").distinct(), "key", "left_anti")


def clear(selected: DataFrame) -> DataFrame:
    return selected.select("key").where(F.lit(False))


def toggle(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """Clicked keys leave the selection if they were in it, and join it if not."""
    sides = selected.select("key", F.lit(1).alias("was")).distinct().unionByName(
        clicked.select("key", F.lit(0).alias("was")).distinct()
    )
    return sides.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("key")


@dataclass(frozen=True)
class Picked:
    """The distinct keys of a selection, stored, measured once and shared by all views."""

    table: DataFrame
    empty: bool
    small: bool

    @property
    def dtype(self) -> T.DataType:
        return self.table.schema["key"].dataType


def picked(selected: DataFrame | Picked) -> Picked:
    """Store and measure the keys of a selection, for use by several flags."""
    if isinstance(selected, Picked):
        return selected
    table = stored(selected.select("key").where("key is not null").distinct())
    return Picked(table, table.isEmpty(), is_small(table))


def _marked(frame: DataFrame, column: str, keys: Picked, mark: str, spread: Sequence[str] | None) -> DataFrame:
    own = type_of(frame, column)
    if is_key(own) or is_key(keys.dtype):  # keys of several kinds on either side
        typed, keyed = keys.table.select(key_of(F.col("key"), keys.dtype).alias("_key")), key_of(F.col(column), own)
    else:
        common = shared_type(own, keys.dtype)
        if common is None:  # values of different kinds are never equal
            return frame.withColumn(mark, F.lit(False))
        # a key that the shared type cannot hold equals none of the column's values
        typed, keyed = keys.table.select(F.col("key").try_cast(common).alias("_key")), F.col(column).cast(common)
    typed = typed.where("_key is not null").distinct().withColumn("_found", F.lit(True))
    keyed = frame.withColumn("_value", keyed)
    joined = lookup(keyed, typed, {"_value": "_key"}, "left", spread, small=keys.small)
    return joined.select(*frame.columns, F.coalesce("_found", F.lit(False)).alias(mark))


def flag(
    frame: DataFrame, columns: Sequence[str], selected: DataFrame | Picked, spread: Sequence[str] | None = None
) -> DataFrame:
    """Add `lit`: any of the columns holds a selected key, or nothing is selected.

    `spread` names columns that tell rows of one key apart; by default the whole row does.
    """
    keys = picked(selected)
    if keys.empty:
        return frame.withColumn("lit", F.lit(True))
    marked, marks = frame, []
    for i, column in enumerate(columns):
        marks.append(f"_m{i}")
        marked = _marked(marked, column, keys, marks[-1], spread)
    lit = reduce(lambda a, b: a | b, [F.col(m) for m in marks])
    return marked.select(*frame.columns, lit.alias("lit"))


def only(
    frame: DataFrame, columns: Sequence[str], selected: DataFrame | Picked, spread: Sequence[str] | None = None
) -> DataFrame:
    """The lit rows alone."""
    return flag(frame, columns, selected, spread).where("lit").drop("lit")


def flag_series(series: DataFrame, selected: DataFrame | Picked) -> DataFrame:
    return flag(series, ["category"], selected, ["ord"])


def flag_entities(known: DataFrame, selected: DataFrame | Picked) -> DataFrame:
    return flag(known, ["entity"], selected)


def flag_links(linked: DataFrame, selected: DataFrame | Picked, spread: Sequence[str] | None = None) -> DataFrame:
    """Chords and graph links: lit if either end is selected."""
    return flag(linked, ["source", "target"], selected, spread)


def flag_nodes(node_rows: DataFrame, selected: DataFrame | Picked) -> DataFrame:
    return flag(node_rows, ["id"], selected)


def _bare(nodes: DataFrame) -> Column:
    return F.col("names" if "names" in nodes.columns else "path")


def flag_tree(laid_out: DataFrame, selected: DataFrame | Picked) -> DataFrame:
    """Light tree nodes, given `hierarchy.layout`.

    Lit are the nodes with a selected name and all their ancestors; and every node that
    shares its name with an ancestor (or the node itself) of the first node, top ring
    first, that carries a selected name. Names are equal if they are in kind and value.
    """
    keys = picked(selected)
    nodes = laid_out.where("depth > 0")
    if keys.empty:
        return nodes.withColumn("lit", F.lit(True))
    kind = F.get("kinds", F.size("kinds") - 1)
    key = F.col("key")
    wanted = keys.table.select(key_text(key, keys.dtype).alias("_key"), key_kind(key, keys.dtype).alias("_of")).distinct()
    asked = nodes if is_key(keys.dtype) else nodes.where(kind == kind_name(keys.dtype))
    numbers = [c for c in ("enter",) if c in nodes.columns]
    asked = asked.select("path", _bare(nodes).alias("names"), "kinds", "depth", "name", kind.alias("_kind"), "place", *numbers)
    named = stored(lookup(asked, wanted, {"name": "_key", "_kind": "_of"}, "left_semi", ["path"], small=keys.small))
    upward = named.select(F.explode(F.sequence(F.lit(0), "depth")).alias("k"), "path")
    paths = upward.select(F.slice("path", F.lit(1), F.col("k")).alias("_lit_path")).distinct()
    way = F.struct("names", "kinds")
    first = named.groupBy("name", "_kind").agg(F.min_by(way, F.struct("depth", "place")).alias("way"))
    root = F.array(F.struct(F.lit(ROOT).alias("names"), F.lit("text").alias("kinds")))
    steps = F.explode(F.concat(root, F.arrays_zip("way.names", "way.kinds"))).alias("step")
    names = first.select(steps).select(F.col("step.names").alias("_lit_name"), F.col("step.kinds").alias("_lit_kind")).distinct()

    # a path occurs once on either side, a name may occur in any number of nodes
    if numbers:  # nodes with intervals hold what is lit without a row per ancestor
        by_path = holding(stored(nodes), named).withColumnRenamed("holds", "_p")
    else:
        by_path = nodes.join(paths.withColumn("_p", F.lit(True)), F.col("path") == F.col("_lit_path"), "left").drop("_lit_path")
    told = by_path.withColumn("_kind", kind)
    by_name = lookup(
        told, names.withColumn("_n", F.lit(True)), {"name": "_lit_name", "_kind": "_lit_kind"}, "left", ["path"]
    )
    lit = F.coalesce("_p", F.lit(False)) | F.coalesce("_n", F.lit(False))
    return by_name.select(*nodes.columns, lit.alias("lit"))


def key_dictionary(
    categories: DataFrame | None = None,
    known: DataFrame | None = None,
    node_rows: DataFrame | None = None,
    laid_out: DataFrame | None = None,
    groups: int = 10,
) -> DataFrame:
    """One stable number per key over all views, in the order the views show them.

    Takes the reduced tables: `series.summary`, `links.entities`, `graph.nodes` and
    `hierarchy.layout`. Keys are told apart by kind and value: the number 1 and the text "1"
    are two keys. `group` repeats after `groups` keys, for callers that have so many marks to
    give. Views come in this order, each in its own; they may be ordered by different types.
    """
    views = []
    for frame, key in [(categories, "category"), (known, "entity"), (node_rows, "id")]:
        if frame is not None:
            dtype = type_of(frame, key)
            views.append((frame, key_text(F.col(key), dtype), key_kind(F.col(key), dtype), [F.col("first_seen")]))
    if laid_out is not None:
        nodes = laid_out.where("depth > 0")
        views.append((nodes, F.col("name"), F.get("kinds", F.size("kinds") - 1), [F.col("depth"), F.col("place")]))
    # each view's order has its own places in the sort key, which are empty in the others
    types = [[frame.select(c).schema.fields[0].dataType for c in order] for frame, _, _, order in views]
    listed = []
    for view, (frame, key, kind, order) in enumerate(views):
        places = [
            (order[i] if view == other else F.lit(None).cast(dtype)).alias(f"o{other}_{i}")
            for other, of_view in enumerate(types)
            for i, dtype in enumerate(of_view)
        ]
        seen = F.struct(F.lit(view).alias("view"), *places)
        listed.append(frame.select(key.alias("key"), kind.alias("kind"), seen.alias("seen")))
    union = reduce(DataFrame.unionByName, listed)
    distinct = stored(union.where("key is not null").groupBy("key", "kind").agg(F.min("seen").alias("seen")))
    return numbered(distinct, "seen").select("key", "kind", "index", (F.col("index") % groups).alias("group"))


def extended_dictionary(known: DataFrame, fresh: DataFrame, groups: int = 10) -> DataFrame:
    """A dictionary that has grown: keys of `known` keep their numbers, the others of `fresh` follow in their order there.

    Both are as `key_dictionary` gives them. Keys that no view shows any more stay, so no number is ever
    given twice. An empty `known` gives `fresh` as it is.
    """
    stays = stored(known.select("key", "kind", "index", "group"))
    used = stays.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    same = (F.col("key") == F.col("_key")) & (F.col("kind") == F.col("_kind"))
    old = stays.select(F.col("key").alias("_key"), F.col("kind").alias("_kind"))
    added = stored(fresh.join(old, same, "left_anti").select("key", "kind", F.col("index").alias("place")))
    behind = numbered(added, "place").select("key", "kind", (F.col("index") + used).cast(stays.schema["index"].dataType).alias("index"))
    return stays.unionByName(behind.withColumn("group", (F.col("index") % groups).cast(stays.schema["group"].dataType)))
