"""Which field plays which part in a view. Checked against the schema before any job runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from viewloom.functions.columns import COMPLEX, is_key, shared_type, type_of


class BindingError(ValueError):
    """A field cannot play the part it is bound to."""


def _names(value: str | Sequence[str]) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(value)


def require_plain(df: DataFrame, field: str, part: str) -> T.DataType:
    dtype = type_of(df, field)
    if isinstance(dtype, COMPLEX) and not is_key(dtype):
        raise BindingError(f"{part}: {field!r} is {dtype.simpleString()}, a plain value is needed")
    return dtype


def require_number(df: DataFrame, field: str, part: str, text: bool = False) -> None:
    dtype = type_of(df, field)
    if isinstance(dtype, T.NumericType) or (text and isinstance(dtype, T.StringType)):
        return
    raise BindingError(f"{part}: {field!r} is {dtype.simpleString()}, a number is needed")


def is_numeric_object(dtype: T.DataType) -> bool:
    """A map or struct all of whose values are numbers; an empty struct counts."""
    if isinstance(dtype, T.MapType):
        return isinstance(dtype.valueType, T.NumericType)
    if isinstance(dtype, T.StructType):
        return all(isinstance(f.dataType, T.NumericType) for f in dtype.fields)
    return False


def require_list_of(df: DataFrame, field: str, key: str, part: str) -> T.DataType:
    """The type in which the keys and the list's elements compare."""
    dtype = type_of(df, field)
    if not isinstance(dtype, T.ArrayType):
        raise BindingError(f"{part}: {field!r} is {dtype.simpleString()}, an array is needed")
    key_type = require_plain(df, key, part)
    common = shared_type(key_type, dtype.elementType)
    if common is None:
        raise BindingError(
            f"{part}: {field!r} holds {dtype.elementType.simpleString()}, "
            f"which never equals {key!r} of type {key_type.simpleString()}"
        )
    return common


def _require_order(order_by: Sequence[str]) -> None:
    if not order_by:
        raise BindingError("order_by: at least one column is needed, rows have no order of their own")


@dataclass(frozen=True)
class Measure:
    """A numeric field, or with agg="entry_sum" the sum over an object's values."""

    field: str
    agg: str = "value"

    def check(self, df: DataFrame, part: str) -> None:
        if self.agg == "value":
            require_number(df, self.field, part)
        elif self.agg == "entry_sum":
            dtype = type_of(df, self.field)
            if not is_numeric_object(dtype):
                raise BindingError(
                    f"{part}: {self.field!r} is {dtype.simpleString()}, an object of numbers is needed"
                )
        else:
            raise BindingError(f"{part}: unknown agg {self.agg!r}")


@dataclass(frozen=True)
class SeriesSpec:
    category: str
    value: str | Measure
    order_by: str | Sequence[str]

    @property
    def order(self) -> tuple[str, ...]:
        return _names(self.order_by)

    @property
    def measure(self) -> Measure:
        return Measure(self.value) if isinstance(self.value, str) else self.value

    def check(self, df: DataFrame) -> None:
        _require_order(self.order)
        require_plain(df, self.category, "category")
        self.measure.check(df, "value")


@dataclass(frozen=True)
class LinkSpec:
    entity: str
    connections: str
    order_by: str | Sequence[str]

    @property
    def order(self) -> tuple[str, ...]:
        return _names(self.order_by)

    def check(self, df: DataFrame) -> T.DataType:
        _require_order(self.order)
        return require_list_of(df, self.connections, self.entity, "connections")


@dataclass(frozen=True)
class GraphSpec:
    node: str
    links: str
    strength: str
    order_by: str | Sequence[str]
    smallest: float = 10.0
    largest: float = 30.0

    @property
    def order(self) -> tuple[str, ...]:
        return _names(self.order_by)

    def check(self, df: DataFrame) -> T.DataType:
        _require_order(self.order)
        require_number(df, self.strength, "strength")
        return require_list_of(df, self.links, self.node, "links")


@dataclass(frozen=True)
class HierarchySpec:
    levels: Sequence[str]
    value: str
    order_by: str | Sequence[str]

    @property
    def order(self) -> tuple[str, ...]:
        return _names(self.order_by)

    def check(self, df: DataFrame) -> None:
        _require_order(self.order)
        if not self.levels:
            raise BindingError("levels: at least one level is needed")
        for level in self.levels:
            require_plain(df, level, "level")
        require_number(df, self.value, "size", text=True)


def accepted(df: DataFrame) -> list[tuple[str, str, str, str, bool]]:
    """(view, part, agg, field, accepted) for each field and each part it might be bound to.

    Told by the checks themselves, from the schema alone. A list is accepted for links if it
    holds plain values, whatever the entity or node it is paired with.
    """

    def holds_plain(field: str) -> None:
        dtype = type_of(df, field)
        if not isinstance(dtype, T.ArrayType) or isinstance(dtype.elementType, COMPLEX):
            raise BindingError(f"{field!r} is {dtype.simpleString()}, an array of plain values is needed")

    checks = [
        ("series", "category", "value", lambda f: require_plain(df, f, "category")),
        ("series", "value", "value", lambda f: Measure(f).check(df, "value")),
        ("series", "value", "entry_sum", lambda f: Measure(f, "entry_sum").check(df, "value")),
        ("links", "entity", "value", lambda f: require_plain(df, f, "entity")),
        ("links", "connections", "value", holds_plain),
        ("graph", "node", "value", lambda f: require_plain(df, f, "node")),
        ("graph", "links", "value", holds_plain),
        ("graph", "strength", "value", lambda f: require_number(df, f, "strength")),
        ("hierarchy", "level", "value", lambda f: require_plain(df, f, "level")),
        ("hierarchy", "size", "value", lambda f: require_number(df, f, "size", text=True)),
    ]
    told = []
    for view, part, agg, check in checks:
        for field in df.columns:
            try:
                check(field)
            except BindingError:
                told.append((view, part, agg, field, False))
            else:
                told.append((view, part, agg, field, True))
    return told
