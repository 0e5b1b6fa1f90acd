"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = b" \t\n\r\x0b\x0c"
SEGMENT = 1 << 20
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_column).cast("string")) % parts


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def slices(batches: Iterator[pa.RecordBatch], size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes (SLICE_BYTES), a row at least: what a worker holds of
    its texts as Python objects does not follow the session's rows per batch."""
    for batch in batches:
        rows = max(1, batch.num_rows * (size or SLICE_BYTES) // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def position(df: DataFrame, name: str) -> int:
    """Where a column stands, by Spark's rule for the case of names."""
    return df.columns.index(name) if name in df.columns else [c.lower() for c in df.columns].index(name.lower())


def raw_words(raw: bytes | None, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text (runs without ASCII white space), in lists of bounded size.

    An ordinary text gives one list; a very long one is cut at white space about every
    `size` bytes, so that memory does not follow the longest text.
    """
    return (segment.split() for segment in segments(raw or b"", size))


def segments(raw: bytes, size: int = SEGMENT) -> Iterator[bytes]:
    """A text cut at white space about every `size` bytes, the last part of it whatever is left."""
    start = 0
    while len(raw) - start > size:
        end = min((at for at in (raw.find(bytes([s]), start + size) for s in SPACES) if at >= 0), default=len(raw))
        yield raw[start:end]
        start = end
    yield raw[start:] if start else raw
