"""Global word lookups for whole texts, without a row per occurrence in any shuffle.

A task numbers the distinct words of a block of texts, the frequent ones low, and keeps each
text as a list of numbers (its words with their positions). From there

* the block's text lists are one row, which goes to the block's task;
* its distinct words are dealt over `buckets` by a hash of the word: a row per block and
  bucket. So equal words of all blocks meet in one task, each block's at most once, and a
  word that is in every text is no heavier than any other;
* answers (ids, counts) go back as a row per block and bucket, and the texts are reassembled
  by position.

Lists are packed as byte planes and compressed. Memory follows the block and the bucket, both
of which are parameters, and not the input. Blocks are formed in one pass whose shuffle both
sides read; `rows` should come from a table, so that a lost task is computed alike again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from viewloom.llm.common import SEGMENT, segments

BLOCK_BYTES = 12 << 20
SLAB_BYTES = 4 << 20
BUCKET_BYTES = 24 << 20


def squeeze(values: np.ndarray) -> bytes:
    """An array of numbers as compressed byte planes."""
    width = values.dtype.itemsize
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(planes, asbytes=True)


def unsqueeze(packed: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], size, asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def squeeze_words(words: Sequence[bytes]) -> tuple[bytes, bytes]:
    """Lengths and bytes of a list of words."""
    joined = np.frombuffer(b"".join(words), np.uint8)
    return squeeze(np.array([len(w) for w in words], np.uint32)), squeeze(joined)


def unsqueeze_words(sizes: bytes, joined: bytes) -> list[bytes]:
    raw = unsqueeze(joined, np.uint8).tobytes()
    ends = np.cumsum(unsqueeze(sizes, np.uint32).astype(np.int64))
    return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def words_of(words: pa.Array) -> list[bytes]:
    """An Arrow array of binary values, none of them null, as a list; several times as fast as its own."""
    kind = np.int64 if pa.types.is_large_binary(words.type) else np.int32
    ends = np.frombuffer(words.buffers()[1], kind)[words.offset : words.offset + len(words) + 1].tolist()
    raw = (words.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def numbered_words(texts: Iterable[bytes | None], size: int | None = None, cut: int = SEGMENT) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """The words of texts (runs without ASCII white space), A-Z in lower case, and an empty word behind each text.

    About `size` bytes of text (SLAB_BYTES) at a time, as numbers into the distinct words, in the order in
    which they first come; so Python sees no word more than once. A text is cut about every `cut` bytes and may go
    over several such slabs; a null or empty one is its empty word alone.
    """
    held, holds = [], 0
    for raw in texts:
        part = None
        for following in segments(raw or b"", cut):
            if part:  # not the last of its text, so no empty word behind it
                held.append(part)
                holds += len(part)
                if holds > (size or SLAB_BYTES):
                    yield _numbered(held)
                    held, holds = [], 0
            part = following.lower().strip()
        held.append(part and part + b" ")  # what is split behind the last space is empty
        holds += len(part) + 1
        if holds > (size or SLAB_BYTES):
            yield _numbered(held)
            held, holds = [], 0
    if held:
        yield _numbered(held)


def _numbered(parts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    # any bytes may be split at ASCII white space; the view as text checks nothing
    split = pa.compute.ascii_split_whitespace(pa.array(parts, pa.large_binary()).view(pa.large_string()))
    found = split.values.view(pa.large_binary()).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def gather(flat: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `at` of lists that lie behind each other in `flat`, and their sizes."""
    starts, taken = np.cumsum(sizes) - sizes, sizes[at]
    first = np.cumsum(taken) - taken
    return flat[np.repeat(starts[at] - first, taken) + np.arange(int(taken.sum()))], taken


def buckets_for(spark: SparkSession, text_bytes: int) -> int:
    """Enough buckets that the words of BUCKET_BYTES of text meet in each, about; so a bucket does not grow with the input."""
    return max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes // BUCKET_BYTES))


def schema_of(id_field: StructField) -> StructType:
    """Rows with bucket -1 hold the texts of a block, the others its words in a bucket."""
    return StructType([
        StructField("block", LongType()), StructField("bucket", IntegerType()),
        StructField("ids", ArrayType(id_field.dataType)), StructField("sizes", BinaryType()),
        StructField("numbers", BinaryType()), StructField("more", BinaryType()), StructField("words", BinaryType()),
    ])


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word) -> int:
        self[word] = number = len(self)
        return number


class Block:
    """Texts as lists of numbers of their distinct words."""

    def __init__(self) -> None:
        self.index = Numbers()
        self.ids: list = []
        self.sizes: list[int] = []
        self.codes: list[np.ndarray] = []

    def add(self, key, words: Iterable[list]) -> None:
        """One text; its words come in lists, so that a long text needs no list of all."""
        number, size = self.index.__getitem__, 0
        for some in words:
            self.codes.append(np.fromiter(map(number, some), np.uint32, len(some)))
            size += len(some)
        self.ids.append(key)
        self.sizes.append(size)

    def add_numbered(self, words: list, codes: np.ndarray) -> None:
        """Items of texts as numbers into distinct `words`; the texts' ids and sizes are the caller's to set."""
        numbers = np.fromiter(map(self.index.__getitem__, words), np.uint32, len(words))
        self.codes.append(numbers[codes])

    def batches(self, block: int, buckets: int, id_type: pa.DataType, more: bytes = b"") -> Iterator[pa.RecordBatch]:
        codes = np.concatenate([*self.codes, np.zeros(0, np.uint32)])
        words = [w if isinstance(w, bytes) else w.encode() for w in self.index]
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        yield _batch(id_type, [(block, -1, self.ids, squeeze(np.array(self.sizes, np.uint32)), squeeze(rank[codes]), more, None)])
        bucket_of = np.array([zlib.crc32(w) % buckets for w in words], np.int64)[order]
        dealt = np.argsort(bucket_of, kind="stable")  # places ascend inside a bucket
        cuts = np.flatnonzero(np.diff(bucket_of[dealt])) + 1
        rows = []
        for places in np.split(dealt, cuts) if len(words) else []:
            sizes, joined = squeeze_words([words[i] for i in order[places]])
            rows.append((block, int(bucket_of[places[0]]), None, sizes, squeeze(places.astype(np.uint32)), None, joined))
        if rows:
            yield _batch(id_type, rows)


def _batch(id_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.list_(id_type), *[pa.binary()] * 4]
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["block", "bucket", "ids", "sizes", "numbers", "more", "words"])


def block_number(partition: int, count: int) -> int:
    return (partition << 24) + count


def meet(packed: DataFrame) -> DataFrame:
    """The blocks dealt by block; both readers of the result share one shuffle."""
    return packed.repartition("block")


def words_by_bucket(dealt: DataFrame) -> DataFrame:
    """The word rows alone, dealt and sorted by bucket: block, bucket, sizes, places, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.compute.greater_equal(batch.column(1), 0)
            yield batch.filter(keep).select(["block", "bucket", "sizes", "numbers", "words"])

    rows = dealt.mapInArrow(run, "block long, bucket int, sizes binary, numbers binary, words binary")
    return rows.repartition("bucket").sortWithinPartitions("bucket")


def texts_of(table: pa.Table) -> dict:
    """The text row among a block's rows."""
    return next(r for r in table.to_pylist() if r["bucket"] < 0)
