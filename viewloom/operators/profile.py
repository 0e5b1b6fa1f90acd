"""What fields there are, of which kind, and which part each may play in which view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from viewloom.functions.columns import order_key
from viewloom.plans.specs import is_numeric_object
from viewloom.sources.records import ROW_ORDER

# Kinds of values, and the schema text by which a variant value of each kind starts.
KINDS = ("string", "number", "boolean", "array", "object")
NUMBER_SCHEMA = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def kind_of(dtype: T.DataType) -> tuple[str, bool]:
    """Kind and numeric flag of a column type."""
    if isinstance(dtype, T.NumericType):
        return "number", True
    if isinstance(dtype, T.StringType):
        return "string", False
    if isinstance(dtype, T.BooleanType):
        return "boolean", False
    if isinstance(dtype, T.ArrayType):
        return "array", False
    if isinstance(dtype, (T.MapType, T.StructType)):
        return "object", is_numeric_object(dtype)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp", False
    return dtype.typeName(), False


def typed_profile(df: DataFrame, order_by: Sequence[str], fields: Sequence[str] | None = None) -> DataFrame:
    """Profile of typed columns: (key, kind, is_numeric, first_seen, position, n_missing).

    Kinds come from the schema; one aggregate over the rows finds where each field is
    first present. A field that is never present is not listed. All fields of the data are
    profiled, the order columns too; only the reader's own `row_order` is left out.
    """
    names = list(fields) if fields is not None else [c for c in df.columns if c != ROW_ORDER]
    place = order_key(df, order_by)
    found = []
    for i, name in enumerate(names):
        column = F.col(f"`{name}`")
        found += [
            F.min(F.when(column.isNotNull(), place)).alias(f"s{i}"),
            F.count(F.when(column.isNull(), 1)).alias(f"m{i}"),
        ]
    one = df.agg(*found)
    entries = []
    for i, name in enumerate(names):
        kind, numeric = kind_of(df.schema[name].dataType)
        entries.append(
            F.struct(
                F.lit(name).alias("key"),
                F.lit(kind).alias("kind"),
                F.lit(numeric).alias("is_numeric"),
                F.col(f"s{i}").alias("first_seen"),
                F.lit(i).alias("position"),
                F.col(f"m{i}").alias("n_missing"),
            )
        )
    return (
        one.select(F.explode(F.array(*entries)).alias("field"))
        .select("field.*")
        .where("first_seen is not null")
    )


def _coded_kind(value: Column, schema: Column) -> Column:
    """Kind as twice its place in KINDS, plus one if numeric; a fixed-width code keeps the
    first-kind aggregate a hash aggregate. Not for null values."""
    entries = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    all_numbers = F.forall(entries, lambda entry: F.schema_of_variant(entry).rlike(NUMBER_SCHEMA))
    return (
        F.when(schema.rlike(NUMBER_SCHEMA), F.lit(2 * KINDS.index("number") + 1))
        .when(schema == "BOOLEAN", F.lit(2 * KINDS.index("boolean")))
        .when(schema.startswith("ARRAY"), F.lit(2 * KINDS.index("array")))
        .when(schema.startswith("OBJECT"), F.lit(2 * KINDS.index("object")) + F.when(all_numbers, 1).otherwise(0))
        .otherwise(F.lit(2 * KINDS.index("string")))
    )


def variant_profile(df: DataFrame, record: str, order_by: Sequence[str], text: str | None = None) -> DataFrame:
    """Profile of records held as VARIANT: the first non-null value of a key gives its kind.

    (key, kind, is_numeric, first_seen, position). Records of mixed shape need no common
    schema. VARIANT keeps keys sorted; with `text`, the column of the records' JSON text, `position`
    is the key's place in the row that shows it first. Without, keys first seen in one row come by name.
    """
    # only objects have fields; any other record adds none, as does an empty object
    fields = F.map_entries(F.try_variant_get(F.col(record), "$", "map<string,variant>"))
    names = F.json_object_keys(text) if text is not None else F.lit(None).cast("array<string>")
    entries = df.select(order_key(df, order_by).alias("ord"), names.alias("names"), F.explode(fields).alias("entry"))
    # the schema text is a column of its own, and no filter depends on it, so that it is
    # made once per value
    told = entries.where(~F.is_variant_null("entry.value")).select(
        "ord", "entry.key", "entry.value", F.schema_of_variant("entry.value").alias("schema"),
        F.coalesce(F.array_position("names", F.col("entry.key")) - 1, F.lit(0)).cast("int").alias("position"),
    )
    coded = told.select("ord", "key", "position", _coded_kind(F.col("value"), F.col("schema")).alias("code"))
    first = coded.groupBy("key").agg(
        F.min_by("code", "ord").alias("code"), F.min("ord").alias("first_seen"), F.min_by("position", "ord").alias("position")
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return first.select(
        "key",
        F.get(kinds, F.shiftright("code", 1)).alias("kind"),
        (F.col("code") % 2 == 1).alias("is_numeric"),
        "first_seen",
        "position",
    )


def roles(profile: DataFrame) -> DataFrame:
    """Which field may play which part: (view, part, field, agg, label, bindable, first_seen, position).

    Categories, entities and nodes are offered for any field, but an array or object
    cannot be bound there, since it has no plain value: `bindable` says so. agg is
    `entry_sum` where the sum over an object's values is offered as the measure.
    """
    any_field = F.lit(True)
    plain = ~F.col("kind").isin("array", "object", "variant")
    plain_number = (F.col("kind") != "object") & F.col("is_numeric")
    number_object = (F.col("kind") == "object") & F.col("is_numeric")
    list_field = F.col("kind") == "array"
    offers = [
        ("series", "category", "value", any_field),
        ("series", "value", "value", plain_number),
        ("series", "value", "entry_sum", number_object),
        ("links", "entity", "value", any_field),
        ("links", "connections", "value", list_field),
        ("graph", "node", "value", any_field),
        ("graph", "links", "value", list_field),
        ("graph", "strength", "value", plain_number),
        ("hierarchy", "level", "value", plain),
        ("hierarchy", "size", "value", plain_number),
    ]
    options = [
        F.when(
            allowed,
            F.struct(
                F.lit(view).alias("view"),
                F.lit(part).alias("part"),
                F.lit(agg).alias("agg"),
                (plain if allowed is any_field else F.lit(True)).alias("bindable"),
            ),
        )
        for view, part, agg, allowed in offers
    ]
    label = F.when(F.col("o.agg") == "entry_sum", F.concat(F.lit("Sum of "), "key")).otherwise(F.col("key"))
    offered = F.explode(F.array_compact(F.array(*options))).alias("o")
    return profile.select("key", "first_seen", "position", offered).select(
        "o.view",
        "o.part",
        F.col("key").alias("field"),
        "o.agg",
        label.alias("label"),
        "o.bindable",
        "first_seen",
        "position",
    )
