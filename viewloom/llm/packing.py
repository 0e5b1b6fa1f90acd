"""Best-fit packing into sequences of several permitted lengths.

Long texts are cut into pieces of the largest length; the last piece and all shorter texts
are packed. Texts are dealt over groups by a hash; a group is packed by best fit, longest
piece first. When no open bin has room, the size that costs least is opened: the price of the
bin, less the worth of the room it leaves for pieces still to come. In the end each bin
shrinks to the least permitted length that holds its contents.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from viewloom.llm.common import slices
from viewloom.llm.vocabulary import Vocabulary

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs: each of its places, an overhead, and attention, which grows with the square.
OVERHEAD, ATTENTION = 64.0, 1 / 16384
GROUP_ROWS = 50_000


def price(capacity: int) -> float:
    return OVERHEAD + capacity + ATTENTION * capacity * capacity


def opened(length: int, later: int, capacities: Sequence[int]) -> int:
    """The size to open for a piece, when `later` tokens in pieces no longer than it follow.

    Room that later tokens can fill is worth what a token costs in the cheapest bin. Of equal
    costs the smaller size is taken.
    """
    worth = min(price(c) / c for c in capacities)
    return min((c for c in capacities if c >= length), key=lambda c: (price(c) - worth * min(c - length, later), c))


def best_fit(lengths: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; lengths descend and none exceeds the largest capacity.

    A piece goes to the open bin with the least room that holds it, of those to the oldest.
    `rooms` has a bit for each amount of room that some bin has.
    """
    later, out, rooms = sum(lengths), [], 0
    bins: list[int] = []  # capacity
    by_room: dict[int, list[int]] = {}
    for length in lengths:
        later -= length
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = heapq.heappop(by_room[room])
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            number, room = len(bins), opened(length, later, capacities)
            bins.append(room)
        out.append((number, bins[number] - room))
        room -= length
        if room:
            heap = by_room.setdefault(room, [])
            if not heap:
                rooms |= 1 << room
            heapq.heappush(heap, number)
    return out


def token_lengths(docs: DataFrame, vocabulary: Vocabulary, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and `n_tokens`, with one end after each text. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = vocabulary.encoding()
        for batch in slices(batches):
            n = [len(encoding.encode_ordinary(t)) + 1 if t else 1 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long").select(F.col("id").alias(id_column), "n_tokens")


def pack(
    lengths: DataFrame,
    id_column: str = "doc_id",
    length_column: str = "n_tokens",
    capacities: Sequence[int] = CAPACITIES,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row per piece: id, `piece`, `start` in the text, `length`, and its `pack`, `bin`, `offset`, `capacity`.

    A bin is named by (pack, bin). Pieces of a full largest length have a bin of their own, in
    packs below 0. Every token of every row is in exactly one piece; a row without tokens has
    no piece, a null length counts as 0. Rows with a null id, and repeated rows, are packed like any other.
    `lengths` is read twice: pass a stored table. The result does not depend on partitions.
    """
    capacities = sorted(set(capacities))
    largest = capacities[-1]
    rows = lengths.select(F.col(id_column).alias("_id"), F.coalesce(length_column, F.lit(0)).cast("long").alias("_n"))
    groups = max(1, -(-rows.count() // group_rows))
    # copies of a row, as of one without an id, are told apart by number, so that they spread too
    alike = rows.groupBy("_id", "_n").agg(F.count(F.lit(1)).alias("_copies"))
    copies = alike.select("_id", "_n", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    dealt = copies.withColumn("_pack", F.pmod(F.xxhash64("_id", "_n", "_copy"), F.lit(groups).cast("long")))
    whole = F.floor(F.col("_n") / largest)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_rest", "descending"), ("_n", "descending"), ("_id", "ascending"), ("_copy", "ascending")])
        lengths = group.column("_rest").to_pylist()
        placed = best_fit(lengths, capacities)
        used: dict[int, int] = {}
        for (number, _), length in zip(placed, lengths):
            used[number] = used.get(number, 0) + length
        shrunk = {number: min(c for c in capacities if c >= n) for number, n in used.items()}
        columns = [[n for n, _ in placed], [offset for _, offset in placed], [shrunk[n] for n, _ in placed]]
        for name, column in zip(["_bin", "_offset", "_capacity"], columns):
            group = group.append_column(name, pa.array(column, pa.int64()))
        return group

    kind = lengths.schema[id_column].dataType.simpleString()
    last = dealt.withColumn("_rest", F.col("_n") % largest).where("_rest > 0")
    packed = last.groupBy("_pack").applyInArrow(
        run, f"_id {kind}, _n long, _copy long, _pack long, _rest long, _bin long, _offset long, _capacity long"
    )
    numbers = whole.cast("long")
    ends = packed.select(
        F.col("_id").alias(id_column), numbers.alias("piece"), (numbers * largest).alias("start"),
        F.col("_rest").alias("length"), F.col("_pack").alias("pack"), F.col("_bin").alias("bin"),
        F.col("_offset").alias("offset"), F.col("_capacity").alias("capacity"),
    )
    full = dealt.where(F.col("_n") >= largest).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), numbers - 1)))
    order = Window.partitionBy("_pack").orderBy("_id", "_n", "_copy", "_piece")
    own = full.select(
        F.col("_id").alias(id_column), F.col("_piece").alias("piece"), (F.col("_piece") * largest).alias("start"),
        F.lit(largest).cast("long").alias("length"), (-1 - F.col("_pack")).alias("pack"),
        (F.row_number().over(order) - 1).cast("long").alias("bin"), F.lit(0).cast("long").alias("offset"),
        F.lit(largest).cast("long").alias("capacity"),
    )
    return ends.union(own)
