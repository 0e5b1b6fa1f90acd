"""Scalar expressions. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

COMPLEX = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
FLOATING = (T.DoubleType, T.FloatType)

# A plain decimal number, the text forms that count as numbers.
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def type_of(df: DataFrame, field: str) -> T.DataType:
    """Type of a field; dotted names reach into structs and maps. Analysis only, no job."""
    return df.select(F.col(field)).schema.fields[0].dataType


# Decimal digits that hold any value of a whole-number type, and one for NULL.
ORDER_DIGITS = {T.BooleanType: 1, T.ByteType: 4, T.ShortType: 6, T.IntegerType: 10, T.DateType: 10, T.LongType: 20}
WIDEST = 38  # digits of the largest decimal


def order_key(df: DataFrame, order_by: Sequence[str]) -> Column:
    """One comparable column for the row order.

    A single column is kept as it is. Several whole-number, date or true/false columns are
    packed into one decimal as long as their digits fit, so that `min`, `min_by` and `max_by`
    stay hash aggregates. Others become a struct, for which Spark sorts the rows first.
    """
    if len(order_by) == 1:
        return F.col(order_by[0])
    digits = [ORDER_DIGITS.get(type(type_of(df, c))) for c in order_by]
    if None in digits or sum(digits) > WIDEST:
        return F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)])
    wide, packed = T.DecimalType(WIDEST, 0), F.lit(0).cast(T.DecimalType(WIDEST, 0))
    for name, size in zip(order_by, digits):
        value = F.unix_date(name) if isinstance(type_of(df, name), T.DateType) else F.col(name)
        lowest = -(1 << 63) if size == 20 else -(1 << 31) if size == 10 else -(10 ** (size - 1)) // 2
        place = F.coalesce(value.cast("bigint").cast(wide) - F.lit(str(lowest)).cast(wide) + 1, F.lit(0))
        packed = (packed * F.lit(str(10**size)).cast(wide) + place).cast(wide)
    return packed


def without_nan(value: Column, dtype: T.DataType) -> Column:
    """NaN as NULL, so that `max` passes over it instead of ranking it highest."""
    if isinstance(dtype, FLOATING):
        return F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return value


def or_zero(value: Column, dtype: T.DataType) -> Column:
    """Missing and NaN measures count as zero."""
    return F.coalesce(without_nan(value, dtype), F.lit(0).cast(dtype))


def measure_type(dtype: T.DataType) -> T.DataType:
    """Decimals stay exact, every other number becomes a double."""
    return dtype if isinstance(dtype, T.DecimalType) else T.DoubleType()


def measure(df: DataFrame, field: str) -> tuple[Column, T.DataType]:
    dtype = measure_type(type_of(df, field))
    return F.col(field).cast(dtype), dtype


def coerced_measure(df: DataFrame, field: str) -> tuple[Column, T.DataType]:
    """As `measure`, and text that spells a number counts as that number, other text as none."""
    if isinstance(type_of(df, field), T.StringType):
        text = F.col(field)
        number = F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))
        return number, T.DoubleType()
    return measure(df, field)


def falsy(value: Column, dtype: T.DataType) -> Column:
    """True for the values an `if` takes as false: null, zero, NaN, empty text, false."""
    if isinstance(dtype, T.StringType):
        empty = value == ""
    elif isinstance(dtype, T.BooleanType):
        empty = ~value
    elif isinstance(dtype, FLOATING):
        empty = (value == 0) | F.isnan(value)
    elif isinstance(dtype, T.NumericType):
        empty = value == 0
    elif is_key(dtype):
        kind, text = value.getField("kind"), value.getField("value")
        empty = (text == "") | ((kind == "number") & text.isin("0", "NaN")) | ((kind == "boolean") & (text == "false"))
    else:
        empty = F.lit(False)
    return value.isNull() | empty


def entry_sum(df: DataFrame, field: str) -> Column:
    """Sum over the values of a map or struct; empty entries add nothing, a NULL object is NULL."""
    dtype = type_of(df, field)
    if isinstance(dtype, T.MapType):
        return F.aggregate(
            F.map_values(field), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0))
        )
    total = F.lit(0.0)
    for name in dtype.fieldNames():
        total = total + F.coalesce(F.col(field).getField(name).cast("double"), F.lit(0.0))
    return F.when(F.col(field).isNotNull(), total)


def area_true(value: Column, largest: Column) -> Column:
    """Share of the radius at which a bar's area is in proportion to its value.

    The sign is kept. When the largest value is zero, every bar takes half the area.
    """
    ratio = F.try_divide(value.cast("double"), largest.cast("double"))
    length = F.signum(ratio) * F.sqrt(F.abs(ratio))
    return F.when(value.isNull(), None).when(largest == 0, F.lit(0.5**0.5)).otherwise(length)


def short_label(text: Column, limit: int = 15) -> Column:
    shown = text.cast("string")
    cut = F.concat(F.substring(shown, 1, limit), F.lit("..."))
    return F.when(F.length(shown) > limit, cut).otherwise(shown)


def number_text(value: Column) -> Column:
    """Digits in groups of three, up to three decimals; halves round away from zero."""
    return F.call_function("format_number", F.round(value.cast("double"), 3), F.lit("#,##0.###"))


#: A key of any kind, as rows of mixed records hold it: its kind and its text.
KEY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())])


def is_key(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StructType) and [(f.name, f.dataType) for f in dtype] == [(f.name, f.dataType) for f in KEY]


def kind_name(dtype: T.DataType) -> str:
    """Kind of a key; keys of different kinds are never equal."""
    if isinstance(dtype, T.StringType):
        return "text"
    return "number" if isinstance(dtype, T.NumericType) else dtype.typeName()


def key_kind(value: Column, dtype: T.DataType) -> Column:
    return value.getField("kind") if is_key(dtype) else F.lit(kind_name(dtype))


_EXPONENT = r"^[+]?(-?)([0-9]*)\.?([0-9]*)E([+-]?[0-9]+)$"


def _written_out(text: Column) -> Column:
    """A number's text with exponent, without it."""
    part = lambda k: F.regexp_extract(text, _EXPONENT, k)
    number = F.struct(part(1).alias("sign"), F.concat(part(2), part(3)).alias("digits"), (F.length(part(2)) + part(4).try_cast("int")).alias("point"))

    def shown(n: Column) -> Column:
        digits, point = n["digits"], n["point"]
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
        middle = F.concat(F.left(digits, point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
        return F.concat(n["sign"], F.when(point <= 0, small).when(point >= F.length(digits), F.rpad(digits, point, F.lit("0"))).otherwise(middle))

    return F.get(F.transform(F.array(number), shown), 0)


def _trimmed(text: Column) -> Column:
    """Without a plus, zeros on either side, a point behind, or the sign of zero."""
    for pattern, instead in ((r"^[+]", ""), (r"(\.[0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^(-?)0+(?=[0-9])", "$1"), (r"^(-?)\.", "$10."), ("^-0$", "0")):
        text = F.regexp_replace(text, pattern, instead)
    return text


def plain_digits(text: Column) -> Column:
    """A number's text written out: no exponent, no zeros around it, so equal numbers have equal texts."""
    return (
        F.when(text.rlike(r"^(0|-?[1-9][0-9]*)$"), text)
        .when(text.rlike(r"^[+-]?[0-9]*\.?[0-9]*$"), _trimmed(text))
        .when(text.rlike(_EXPONENT), _trimmed(_written_out(text)))
        .otherwise(text)
    )


def key_text(value: Column, dtype: T.DataType) -> Column:
    """A key as text, such that keys of one kind are equal if and only if their texts are.

    Numbers are printed alike in all number types and sizes: 2020, not 2020.0 or 2.02E3.
    """
    if is_key(dtype):
        return value.getField("value")
    shown = value.cast("string")
    if isinstance(dtype, FLOATING):
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(plain_digits(value.cast("double").cast("string")))
    if isinstance(dtype, T.DecimalType):
        return plain_digits(shown)
    return shown


def key_of(value: Column, dtype: T.DataType) -> Column:
    """Any plain column as a KEY; a null stays null."""
    if is_key(dtype):
        return value
    return F.when(value.isNotNull(), F.struct(key_kind(value, dtype).alias("kind"), key_text(value, dtype).alias("value")))


def key_literal(value: object) -> Column:
    """A Python value as a KEY."""
    if isinstance(value, bool):
        kind, text = "boolean", str(value).lower()
    elif isinstance(value, str):
        kind, text = "text", value
    else:
        kind, text = "number", None
    shown = F.lit(text) if text is not None else plain_digits(F.lit(str(value).upper()))
    return F.struct(F.lit(kind).alias("kind"), shown.alias("value"))


def path_text(path: Column) -> Column:
    """`root > A > B`; a missing name is printed empty."""
    return F.array_join(F.concat(F.array(F.lit("root")), path), " > ", "")


def shared_type(left: T.DataType, right: T.DataType) -> T.DataType | None:
    """Type in which two key columns compare exactly, or None where they can never be equal.

    Decimals and whole numbers compare as a decimal that holds both; None if none is wide
    enough. Numbers compare as doubles only if one of them is floating.
    """
    if is_key(left) and is_key(right):
        return KEY
    if left == right:
        return left
    if isinstance(left, T.StringType) and isinstance(right, T.StringType):
        return T.StringType()
    if not (isinstance(left, T.NumericType) and isinstance(right, T.NumericType)):
        return None
    if isinstance(left, FLOATING) or isinstance(right, FLOATING):
        return T.DoubleType()
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    whole, scale = zip(*[(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in (left, right)])
    precision = max(whole) + max(scale)
    return T.DecimalType(precision, max(scale)) if precision <= WIDEST else None
