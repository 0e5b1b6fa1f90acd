"""Joins and running sums whose largest task stays small however the keys are spread.

Sizes are looked at before anything is planned. A small table, in rows and in bytes, is
broadcast to the rows that look it up, which then stay where they are. Otherwise the keys are
counted once; counting combines on the map side, so it is cheap even for a key that holds a
third of all rows, and it reads the key columns only. Most often no key is hot and the plain
join or window is planned. Hot keys are dealt over tasks of about ROWS_PER_TASK rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from viewloom.operators.staging import stored

ROWS_PER_TASK = 250_000  # so many rows of one key suit one task; a key with more is hot
MOST_SLICES = 100_000  # parts that all hot keys are cut into; beyond, parts grow instead
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20  # a looked-up table up to this size is broadcast
OVERSAMPLE = 8  # rows looked at for each cut point


def _width(df: DataFrame) -> Column:
    """About the bytes of a row."""
    sizes = [F.lit(16 * len(df.columns)).cast("bigint")]
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            sizes.append(F.octet_length(column))
        elif isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
            sizes.append(F.octet_length(F.to_json(F.struct(column))))
    return reduce(lambda a, b: a + b, [F.coalesce(s.cast("bigint"), F.lit(0)) for s in sizes])


def is_small(df: DataFrame) -> bool:
    """Whether the table may be broadcast. One job over it: pass a stored or reduced table."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(_width(df))).first()
    return rows <= SMALL_ROWS and (size or 0) <= SMALL_BYTES


def hinted(df: DataFrame) -> DataFrame:
    """For a table whose rows MOST_SLICES bounds: broadcast it unless its keys are very wide."""
    size = df.agg(F.sum(_width(df))).first()[0] or 0
    return F.broadcast(df) if size <= SMALL_BYTES else df


def row_hash(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A hash that tells rows apart, of the named columns or of all that can be hashed."""
    usable = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(f"`{c}`") for c in usable])


def hot_keys(
    df: DataFrame, keys: Sequence[str], names: Sequence[str], counts: DataFrame | None = None
) -> DataFrame | None:
    """The hot keys under new names, each with the number of slots to deal it over.

    None if there are none. There are at most MOST_SLICES slots and so no more hot keys.
    `counts`, one row per key with `n_rows`, saves a pass where the counts are known.
    """
    if counts is None:
        counts = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")))
    total, largest = counts.agg(F.sum("n_rows"), F.max("n_rows")).first()
    per_slot = max(ROWS_PER_TASK, -(-(total or 0) // MOST_SLICES))
    if (largest or 0) <= per_slot:
        return None
    slots = F.ceil(F.col("n_rows") / per_slot).cast("int").alias("_slots")
    hot = counts.where(F.col("n_rows") > per_slot)
    return stored(hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], slots, F.col("n_rows").alias("_rows")))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Mapping[str, str],
    how: str,
    spread: Sequence[str] | None = None,
    counts: DataFrame | None = None,
    small: bool | None = None,
) -> DataFrame:
    """Join each left row to the right row with the same key (at most one per key).

    Keys compare null-safely. `how` is inner, left or left_semi. The right side is measured
    (pass a stored frame, or `small` if that is known) and broadcast if small. A larger one
    is joined by shuffle: a hot left key is dealt over its slots by a hash of the `spread`
    columns, by default of the whole row, and the right row of that key is repeated once per
    slot. `counts` may give the left rows per key, as `n_rows`, where they are known already.
    """
    left_keys = list(on)
    hot_names, right_names = [f"_h{i}" for i in range(len(on))], [f"_r{i}" for i in range(len(on))]
    added = [c for c in right.columns if c not in on.values()]
    shown = [*left.columns, *([] if how == "left_semi" else added)]
    keyed = right.select(*[F.col(k).alias(r) for k, r in zip(on.values(), right_names)], *added)
    if is_small(right) if small is None else small:
        return left.join(F.broadcast(keyed), _same(left_keys, right_names), how).select(*shown)
    hot = hot_keys(left, left_keys, hot_names, counts)
    if hot is None:
        return left.join(keyed, _same(left_keys, right_names), how).select(*shown)

    hot = hinted(hot)
    slot = F.pmod(row_hash(left, spread), F.col("_slots").cast("bigint")).cast("int")
    dealt = left.join(hot, _same(left_keys, hot_names), "left").select(
        *left.columns, F.coalesce(slot, F.lit(0)).alias("_slot")
    )
    last = F.coalesce(F.col("_slots"), F.lit(1)) - 1
    copies = keyed.join(hot, _same(right_names, hot_names), "left").select(
        *right_names, *added, F.explode(F.sequence(F.lit(0), last)).alias("_copy")
    )
    match = _same(left_keys, right_names) & (F.col("_slot") == F.col("_copy"))
    return dealt.join(copies, match, how).select(*shown)


def _cuts(order: str) -> Column:
    """Every so many of the sampled order values, in order: about equal slices between them."""
    every = min(OVERSAMPLE, ROWS_PER_TASK)
    return F.filter(F.sort_array(F.collect_list(order)), lambda x, i: i % every == every - 1)


def _slice_of(order: str, cuts: str) -> Column:
    """How many cut points lie below the row, by binary search."""
    steps, step = [], 1 << (2 * MOST_SLICES).bit_length()
    while step:
        steps.append(F.lit(step))
        step //= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda low, step: F.when(F.get(F.col(cuts), low + step - 1) < F.col(order), low + step).otherwise(low),
    )


def sum_before(
    df: DataFrame,
    order: str,
    sums: Mapping[str, Column],
    by: Sequence[str] = (),
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add, per name in `sums`, the sum over the rows that come earlier in the same group.

    `order` must be unique within a group. Groups of ordinary size are summed by a plain
    window. A hot group (with no `by`, a frame of more than ROWS_PER_TASK rows) is cut into
    slices by its own order: each has its own running sum, to which the total of the slices
    before it is added. The slices of all groups are about MOST_SLICES at most, so their
    totals are few. `df` is read several times: pass a stored frame. `counts` may give the
    rows per group, as `n_rows`, where they are known already.
    """
    by = list(by)
    marks = [f"_g{i}" for i in range(len(by))]
    before = (Window.unboundedPreceding, -1)
    total = None if by else df.count()
    hot = hot_keys(df, by, marks, counts) if by else None
    if hot is None and (by or total <= ROWS_PER_TASK):
        rows = Window.partitionBy(*by).orderBy(order).rowsBetween(*before)
        return df.select(
            "*", *[F.coalesce(F.sum(c).over(rows), F.lit(0)).alias(name) for name, c in sums.items()]
        )

    # a fixed share of the rows, the same on every run, tells where to cut; cut points decide
    # only how rows are grouped into tasks, never the result
    total = hot.agg(F.sum("_rows")).first()[0] if by else total
    per_slice = max(ROWS_PER_TASK, -(-total // MOST_SLICES))
    share = F.pmod(F.xxhash64(*by, order), F.lit(max(1, per_slice // OVERSAMPLE))) == 0
    kept, values = df.columns, [f"_v_{name}" for name in sums]
    if by:
        hot = hinted(hot)
        sampled = df.where(share).join(hot, _same(by, marks), "inner")
        cut = hinted(stored(sampled.groupBy(*marks).agg(_cuts(order).alias("_cuts"))))
        groups = [F.col(m).alias(f"_c{m}") for m in marks]
        marked = df.join(hot, _same(by, marks), "left").withColumn("_hot", F.col("_slots").isNotNull())
        marked = marked.join(cut.select(*groups, "_cuts"), _same(marks, [f"_c{m}" for m in marks]), "left")
    else:
        cut = df.where(share).agg(_cuts(order)).scalar()
        marked = df.withColumns({"_hot": F.lit(True), "_cuts": cut})
    inside = F.when(F.col("_hot"), _slice_of(order, "_cuts")).otherwise(F.lit(-1))
    sliced = marked.select(*kept, inside.alias("_slice"), *[c.alias(v) for c, v in zip(sums.values(), values)])
    cuts = Window.partitionBy(*marks).orderBy("_cut").rowsBetween(*before)
    totals = (
        sliced.where("_slice >= 0")
        .groupBy(*[F.col(b).alias(m) for b, m in zip(by, marks)], F.col("_slice").alias("_cut"))
        .agg(*[F.sum(v).alias(v) for v in values])
    )
    bases = stored(totals.select(*marks, "_cut", *[F.sum(v).over(cuts).alias(f"_b{v}") for v in values]))
    rows = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(*before)
    running = sliced.select(*kept, "_slice", *[F.sum(v).over(rows).alias(f"_w{v}") for v in values])
    match = F.col("_slice") == F.col("_cut")
    if by:
        match = match & _same(by, marks)
    joined = running.join(hinted(bases), match, "left")
    return joined.select(
        *kept,
        *[
            (F.coalesce(F.col(f"_w{v}"), F.lit(0)) + F.coalesce(F.col(f"_b{v}"), F.lit(0))).alias(name)
            for name, v in zip(sums, values)
        ],
    )


def numbered(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    """Number the rows from 0 in the given order."""
    return sum_before(df, order, {name: F.lit(1)})
