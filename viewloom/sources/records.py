"""Readers for JSON records. For volume use JSON Lines or Parquet, or for one large JSON array
`sources.arrays`: Spark's own reader takes such a file with one task."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

ROW_ORDER = "row_order"
BAD_RECORD = "_corrupt_record"

# A row's place is one decimal of 38 digits: 13 for the file, 15 for the block's start, 10
# for the row. Being of fixed width, it keeps first and last row aggregates hash aggregates.
BLOCK, ROW = 15, 10
SMALL_BYTES = 16 << 20  # a list of paths up to this size is broadcast
EMPTY_HOST = r"^([A-Za-z0-9+.-]+):///"
TASK_BITS = 33  # `monotonically_increasing_id` counts a task's rows in its low bits


def packed_order(file: Column, block: Column) -> Column:
    """The order of a row of a file source, from the file's number and the block's start."""
    return packed_place(file, block, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << TASK_BITS) - 1)))


def packed_place(file: Column, block: Column, row: Column) -> Column:
    wide = "decimal(38,0)"

    def times(value: Column, digits: int) -> Column:
        return (value.cast(wide) * F.lit(str(10**digits)).cast(wide)).cast(wide)

    return (times(file, BLOCK + ROW) + times(block, ROW) + row.cast(wide)).cast(wide)


def plain_path(path: Column) -> Column:
    """A path without a host is written with one slash or three; here with one."""
    return F.regexp_replace(path, EMPTY_HOST, "$1:/")


def file_numbers(df: DataFrame) -> DataFrame:
    """(_path, _file): the files of a file source, numbered in the order of their paths."""
    paths = [re.sub(EMPTY_HOST, r"\1:/", path) for path in sorted(df.inputFiles())]
    numbered = pa.table({"_path": pa.array(paths, pa.string()), "_file": pa.array(range(len(paths)), pa.int64())})
    files = df.sparkSession.createDataFrame(numbered)
    return F.broadcast(files) if sum(map(len, paths)) <= SMALL_BYTES else files  # else left to Spark


def with_row_order(df: DataFrame) -> DataFrame:
    """Add `row_order`: file, block of the file, and rising number within the block.

    `df` is a frame of a file source, filtered or not. Files count in the order of their
    paths. The row number depends on how files are dealt to tasks, but within a block it
    always rises with the row, so the order is that of the files whatever the partitioning.
    """
    if ROW_ORDER in df.columns:
        return df
    placed = df.select(
        "*",
        plain_path(F.col("_metadata.file_path")).alias("_of"),
        packed_order(F.lit(0), F.col("_metadata.file_block_start")).alias(ROW_ORDER),
    )
    found = placed.join(file_numbers(df), F.col("_of") == F.col("_path"), "left")
    number = F.coalesce("_file", F.raise_error(F.concat(F.lit("not among the input files: "), "_of")).cast("bigint"))
    file = number.cast("decimal(38,0)") * F.lit(str(10 ** (BLOCK + ROW))).cast("decimal(38,0)")
    return found.select(*df.columns, (F.col(ROW_ORDER) + file).cast("decimal(38,0)").alias(ROW_ORDER))


def in_order(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add the reader's order if it is asked for and not there yet."""
    return with_row_order(df) if ROW_ORDER in order_by else df


def read_records(
    spark: SparkSession,
    path: str,
    lines: bool = False,
    schema: str | None = None,
    keep_bad: bool = False,
    numbered: bool = True,
) -> DataFrame:
    """Typed records: a file holding an array gives a row per element, one object one row.

    `lines` reads one object, or one array of objects, per line. Without a schema Spark infers
    one over all rows and widens where they disagree. Malformed input raises when the frame
    is used; with `keep_bad` it is kept instead, as text, in the `_corrupt_record` column.
    With numbered=False the rows get no `row_order` yet; filters then still reach the scan,
    and operators bound to `row_order` add it themselves.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(f"{schema}, {BAD_RECORD} string" if keep_bad else schema)
    if keep_bad:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD_RECORD)
    else:
        reader = reader.option("mode", "FAILFAST")
    read = reader.json(path)
    return with_row_order(read) if numbered else read


def read_variants(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Records of mixed shape, each kept as it is in one VARIANT column `record`.

    Without `lines` a file is one value; an array gives a record per element, in their order.
    """
    reader = spark.read.option("multiLine", not lines).option("mode", "FAILFAST")
    read = with_row_order(reader.option("singleVariantColumn", "record").json(path))
    if lines:
        return read
    elements = F.try_variant_get("record", "$", "array<variant>")
    each = read.select(ROW_ORDER, F.posexplode(F.coalesce(elements, F.array("record"))).alias("element", "record"))
    # a file is one row here: its element's number takes the place of the row's
    return each.select("record", (F.col(ROW_ORDER) + F.col("element")).cast("decimal(38,0)").alias(ROW_ORDER))


def parse_variants(df: DataFrame, text: str) -> DataFrame:
    """Add `record`: the JSON text column as VARIANT. Malformed text raises."""
    return df.withColumn("record", F.parse_json(text))
