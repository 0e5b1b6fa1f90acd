"""Files that hold one large JSON array (or one object), read by as many tasks as they have byte ranges.

Whether a brace opens a record depends on all text before it: whether it stands inside a
string, and how deep. But that state composes: what a range of bytes does to it can be told
without knowing the state it begins with, since it is one of two things inside strings or
outside, and a shift in depth. So

1. every range is scanned for both cases (a row per range);
2. running sums over the ranges of a file give the state each begins with;
3. every range is scanned again, and cut into its records. Only the record that reaches over
   a range's end, and what a range has before its first record, meet in a shuffle.

Ranges are those of Spark's own text reader, which ends its lines at `{` here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from viewloom.operators.skew import is_small
from viewloom.operators.staging import stored
from viewloom.sources.records import ROW_ORDER, file_numbers, packed_place, plain_path

_ESCAPE = re.compile(rb"\\.", re.S)
WHOLE, OPEN, HEAD = 0, 1, 2  # a record inside its range; one that may go on behind it; what is before the first


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes, bool, bool]]:
    """(columns of the range, bytes, first, last) of each range, batch by batch; the braces at which lines end put back."""
    held = None
    for batch in batches:
        names = batch.schema.names[:-1]
        keys = list(zip(*(batch.column(n).to_pylist() for n in names)))
        values = batch.column("value").to_pylist()
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            first = held is None or held[0] != keys[at]
            if held is not None:
                yield *held, first
            lead = b"" if first and keys[at][1] == 0 else b"{"
            held = (keys[at], lead + b"{".join(values[at:end]), first)
            at = end
    if held is not None:
        yield *held, True


def _marks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Per byte: whether an odd number of quotes came before, and by how much it would change the depth."""
    plain = np.frombuffer(_ESCAPE.sub(b"  ", data), np.uint8)
    quotes = np.cumsum(plain == 34) & 1
    change = np.isin(plain, (91, 123)).astype(np.int8) - np.isin(plain, (93, 125)).astype(np.int8)
    return quotes.astype(bool), change


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: whether it turns strings inside out, its change of depth if begun outside or inside, and its first mark."""
    turned, shift, mark = False, [0, 0], None
    for (path, block), data, first, last in _pieces(batches):
        if first:
            turned, shift, mark = False, [0, 0], None
        odd, change = _marks(data)
        one = [int(change[~odd].sum()), int(change[odd].sum())]
        shift = [shift[h] + one[h ^ turned] for h in (0, 1)]
        turned ^= bool(odd[-1]) if len(odd) else False
        mark = mark or data.lstrip(b" \t\r\n\xef\xbb\xbf")[:1].decode(errors="replace")
        if last:
            yield pa.RecordBatch.from_pylist([{"path": path, "block": block, "turned": int(turned), "outside": shift[0], "inside": shift[1], "mark": mark}],
                                             pa.schema([("path", pa.string()), ("block", pa.int64()), ("turned", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("mark", pa.string())]))


_CUT = pa.schema([("path", pa.string()), ("block", pa.int64()), ("base", pa.int32()), ("number", pa.int64()), ("part", pa.int32()), ("text", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of ranges whose state is known; those that end at the next record's begin are whole."""
    inside, depth, number, held, part = False, 0, 0, [], HEAD
    for (path, block, before_inside, before_depth, base), data, first, last in _pieces(batches):
        if first:
            inside, depth, number, held, part = bool(before_inside), before_depth, 0, [], HEAD
        odd, change = _marks(data)
        change = np.where(odd ^ inside, 0, change)
        reached = depth + np.cumsum(change)
        opens = (np.frombuffer(data, np.uint8) == 123) & (change == 1) & (reached == base + 1)
        out, at = [], 0
        for begin in np.flatnonzero(opens).tolist():
            held.append(data[at:begin])
            out.append((path, block, base, number, HEAD if part == HEAD else WHOLE, b"".join(held).decode()))
            number, held, part, at = number + 1, [], OPEN, begin
        held.append(data[at:])
        if len(data):
            inside ^= bool(odd[-1])
            depth = int(reached[-1])
        if last:
            out.append((path, block, base, number, part, b"".join(held).decode()))
        columns = [pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(_CUT), _CUT)]
        yield pa.RecordBatch.from_arrays(columns, schema=_CUT)


def _bad(path: Column, what: str) -> Column:
    return F.raise_error(F.concat(F.lit(f"malformed JSON, {what}: "), path))


def _states(ranges: DataFrame) -> DataFrame:
    """Per range the state it begins with: in_text, depth, and base, the depth at which records stand (1 in an array)."""
    of_file = Window.partitionBy("path")
    before = of_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("turned").over(before), F.lit(0)) % 2
    base = F.max(F.when(F.col("block") == 0, (F.col("mark") == "[").cast("int"))).over(of_file)
    known = ranges.withColumns({"in_text": inside, "base": base})
    change = F.when(F.col("in_text") == 0, F.col("outside")).otherwise(F.col("inside"))
    known = known.withColumn("change", change)
    known = known.withColumns({"depth": F.coalesce(F.sum("change").over(before), F.lit(0)), "total": F.sum("change").over(of_file), "turns": F.sum("turned").over(of_file) % 2})
    complete = (F.col("total") == 0) & (F.col("turns") == 0)
    depth = F.when(complete, F.col("depth")).otherwise(_bad(F.col("path"), "it ends too early").cast("bigint"))
    return known.select(F.col("path").alias("of"), F.col("block").alias("at"), F.col("in_text").cast("int").alias("in_text"), depth.alias("depth"), "base")


def _trimmed(text: Column, last: Column, base: Column, path: Column) -> Column:
    """A record without what separates it from the next one; anything else behind it is refused."""
    record = F.regexp_extract(text, r"(?s)^(.*\})", 1)
    rest = F.substring(text, F.length(record) + 1, F.length(text))
    end = F.when(~last, ",").when(base == 1, "]").otherwise("")
    return F.when(F.regexp_replace(rest, r"[ \t\r\n]", "") == end, record).otherwise(_bad(path, "not a list of records"))


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """The records of array or single-object files as JSON text: (text, row_order).

    Strings that hold braces, brackets and escaped quotes, and records over any number of ranges are
    fine; so are an empty array and an empty file, which give no record. What is not a list of objects raises
    when the frame is used. A record in pieces is put together in one task, so memory follows
    the largest record.
    """
    lines = spark.read.option("lineSep", "{").text(path)
    rows = lines.select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )
    ranges = rows.mapInArrow(_summaries, "path string, block long, turned int, outside long, inside long, mark string")
    states = stored(_states(stored(ranges)))
    # a plain broadcast or shuffle join keeps no order of rows; the ranges are scanned in the order of their lines
    placed = _with_states(rows, states)
    cut = placed.mapInArrow(_cut, "path string, block long, base int, number long, part int, text string")
    pieces = stored(cut.where(F.col("part") != WHOLE))
    in_file = Window.partitionBy("path").orderBy("block", F.desc("part"))
    owner = F.last(F.when(F.col("part") == OPEN, F.col("block")), ignorenulls=True).over(in_file)
    owners = pieces.select("path", "block", "part", owner.alias("owner"))
    owners = owners.withColumn("last", F.coalesce(F.col("owner") == F.max("owner").over(Window.partitionBy("path")), F.lit(False)))
    joined = pieces.join(owners, ["path", "block", "part"])
    parts = F.sort_array(F.collect_list(F.struct("block", (-F.col("part")).alias("part"), "text")))
    number = F.max(F.when(F.col("part") == OPEN, F.col("number")))
    spanning = joined.groupBy("path", "owner", "base", "last").agg(
        number.alias("number"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")
    )
    spanning = stored(spanning)
    some = spanning.where("owner IS NOT NULL").select(F.col("path").alias("of")).distinct()
    heads = spanning.where("owner IS NULL").join(some, F.col("path") == F.col("of"), "left")
    begin = F.regexp_replace("text", "[ \t\r\n\ufeff]", "")
    fine = F.when(F.col("of").isNull(), begin.isin("", "[]")).otherwise(begin == F.when(F.col("base") == 1, "[").otherwise(""))
    heads.select(F.when(~fine, _bad(F.col("path"), "not a list of records"))).write.format("noop").mode("overwrite").save()

    shown = lambda last: _trimmed(F.col("text"), last, F.col("base"), F.col("path")).alias("text")
    whole = cut.where(F.col("part") == WHOLE).select("path", "block", F.col("number"), shown(F.lit(False)))
    over = spanning.where("owner IS NOT NULL").select("path", F.col("owner").alias("block"), "number", shown(F.col("last")))
    found = whole.union(over).join(file_numbers(lines), F.col("path") == F.col("_path"), "left")
    return found.select("text", packed_place(F.col("_file"), F.col("block"), F.col("number")).alias(ROW_ORDER))


def _with_states(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Each line with the state its range begins with. A join by broadcast leaves lines where they are."""
    columns = ["path", "block", "in_text", "depth", "base", "value"]
    if is_small(states):
        match = (F.col("path") == F.col("of")) & (F.col("block") == F.col("at"))
        return rows.join(F.broadcast(states), match).select(*columns)
    line = F.monotonically_increasing_id().alias("line")
    moved = rows.select("*", line).join(states, (F.col("path") == F.col("of")) & (F.col("block") == F.col("at")))
    return moved.sortWithinPartitions("path", "block", "line").select(*columns)


def read_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The records of files that hold one array, or one object, each: typed, or without a schema as VARIANT `record`.

    As `records.read_records` and `read_variants`, whose file is read by one task, but by one task per byte range.
    """
    texts = record_texts(spark, path)
    if schema is None:
        return texts.select(F.parse_json("text").alias("record"), ROW_ORDER)
    parsed = texts.select(F.from_json("text", schema, {"mode": "FAILFAST"}).alias("r"), ROW_ORDER)
    return parsed.select("r.*", ROW_ORDER)
