"""Views over records of mixed shape: a typed frame with a column per bound field and part.

A field may hold a number in one record and text in the next. Where it plays the part of a
key, each row gives a KEY of its own kind; as a measure, numbers count and all else is missing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from viewloom.functions.columns import NUMBER_TEXT, plain_digits
from viewloom.operators.profile import NUMBER_SCHEMA
from viewloom.plans.specs import GraphSpec, HierarchySpec, LinkSpec, SeriesSpec
from viewloom.sources.records import ROW_ORDER, with_row_order


def field(record: Column, name: str) -> Column:
    """A field of a VARIANT object, null if it has none."""
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(record, f"$[{quote}{name}{quote}]", "variant")


def variant_key(value: Column) -> Column:
    """A plain VARIANT as a KEY; null for null, lists and objects."""
    schema, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    number = schema.rlike(NUMBER_SCHEMA)
    kind = F.when(number, "number").when(schema == "STRING", "text").when(schema == "BOOLEAN", "boolean")
    shown = F.when(number, plain_digits(text)).otherwise(text)
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), shown.alias("value")))


def variant_keys(value: Column) -> Column:
    """A VARIANT list as KEYs; null for anything else."""
    return F.transform(F.try_variant_get(value, "$", "array<variant>"), variant_key)


def variant_number(value: Column) -> Column:
    """A VARIANT number as a double; null for anything else."""
    return F.when(F.schema_of_variant(value).rlike(NUMBER_SCHEMA), F.try_variant_get(value, "$", "double"))


def variant_size(value: Column) -> Column:
    """As `variant_number`, and text that spells a number counts as that number."""
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
    return F.coalesce(variant_number(value), F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double")))


def variant_entry_sum(value: Column) -> Column:
    """The sum of the numbers in a VARIANT object; null for anything else."""
    entries = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    return F.aggregate(entries, F.lit(0.0), lambda total, x: total + F.coalesce(variant_number(x), F.lit(0.0)))


def bind(records: DataFrame, record: str, specs: Mapping[str, object]) -> tuple[DataFrame, dict[str, object]]:
    """The frame that the specs need, and the specs on its columns. Order columns stay as they are."""
    found: dict[tuple[str, object], str] = {}
    columns: list[Column] = []

    def column(name: str, part) -> str:
        if (name, part) not in found:
            found[name, part] = f"field_{len(found)}"
            columns.append(part(field(F.col(record), name)).alias(found[name, part]))
        return found[name, part]

    bound: dict[str, object] = {view: None for view in specs}
    order: list[str] = []
    for view, spec in specs.items():
        if spec is None:
            continue
        order += [c for c in spec.order if c not in order]
        if isinstance(spec, SeriesSpec):
            measure = spec.measure
            value = column(measure.field, variant_entry_sum if measure.agg == "entry_sum" else variant_number)
            bound[view] = replace(spec, category=column(spec.category, variant_key), value=value)
        elif isinstance(spec, LinkSpec):
            bound[view] = replace(spec, entity=column(spec.entity, variant_key), connections=column(spec.connections, variant_keys))
        elif isinstance(spec, GraphSpec):
            ends = {"node": column(spec.node, variant_key), "links": column(spec.links, variant_keys)}
            bound[view] = replace(spec, **ends, strength=column(spec.strength, variant_number))
        elif isinstance(spec, HierarchySpec):
            levels = [column(level, variant_key) for level in spec.levels]
            bound[view] = replace(spec, levels=levels, value=column(spec.value, variant_size))
    if ROW_ORDER in order:
        records = with_row_order(records)
    return records.select(*order, *columns), bound
