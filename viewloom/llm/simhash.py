"""SimHash near-dedup with bit-sliced comparison.

Close fingerprints (`near_duplicates`), exactly:

1. Every text gets a 64-bit fingerprint; equal fingerprints become one row at once.
2. Fingerprints that differ in at most `RADIUS` = 2 bits agree in at least 6 of 8 bytes, so
   they share a bucket for at least one of the 28 choices of two bytes to leave out. A bucket
   holds distinct fingerprints that agree in 48 bits: 65,536 at the very most, for any data.
3. Inside buckets the distances are counted on bit planes (bitslice).
4. A linked pair is emitted in one bucket only. A fingerprint has at most 2,080 others within
   two bits, so links grow with the distinct fingerprints and not with their square.
5. Links are joined to classes by distributed connected components.

Similar texts (`similar`): texts that share a given part of their shingles are about ten of 64
bits apart, where two bits find little. So these use 256 bits that count every distinct shingle once, the radius that belongs to the
similarity, and buckets of agreeing bits drawn at random, as many as find a pair at the
threshold with probability RECALL; each bucket emits the closest pairs that connect it, fewer
than it has rows. The shingles of emitted pairs are then compared exactly. Where that leaves texts
apart that close pairs connect, a prefix filter on their shingles, rarest first, finds all alike pairs
among them (`_rest`), so no pair is lost because another one was emitted in its place. Short texts, of whose bits too few
shingles decide, meet through their shingles as well: texts that alike share one of the least few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructField, StructType

from viewloom.llm.bitslice import close_pairs, nearest_forest
from viewloom.llm.common import raw_words, slices
from viewloom.llm.components import components
from viewloom.llm.word_blocks import squeeze, unsqueeze
from viewloom.operators.skew import hinted, hot_keys, lookup
from viewloom.operators.staging import stored

RADIUS = 2
BANDS = 8
LEFT_OUT = list(combinations(range(BANDS), RADIUS))
SEED = 42
#: For similar texts: bits, how surely a pair at the threshold shares a bucket, rows aimed at in
#: a bucket, and rows from which a bucket is split. Larger buckets need fewer keys: bit slicing
#: compares 64 pairs at once, while each key shuffles every fingerprint.
WIDE, RECALL, BUCKET_ROWS, CROWD = 256, 0.99, 512, 4096
#: A pair at the threshold may differ in so many standard deviations more bits than expected:
#: buckets are laid out to find it there, and the radius lets it pass.
FOUND_AT, RADIUS_AT = 1.5, 2.5
#: Texts of fewer distinct shingles are found through their shingles, whatever their fingerprints.
SHORT = 64
#: Texts whose shingles are compared with each other come in slices of about so many rows and bytes.
SLICE_ROWS, SLICE_BYTES = 2048, 8 << 20


def _mask(left_out: tuple[int, ...]) -> int:
    """The bits of all other bands, as a signed long."""
    bits = sum(0xFF << (8 * band) for band in range(BANDS) if band not in left_out)
    return bits - (1 << 64) if bits >> 63 else bits


def _shingles(raw: bytes | None, size: int) -> Iterator[list[bytes]]:
    """The shingles of a text, in lists of bounded size; fewer words make one, no words none."""
    tail: list[bytes] = []
    total = 0
    for words in raw_words((raw or b"").lower()):
        words = tail + words
        if len(words) >= size:
            yield list(map(b" ".join, zip(*(words[i:] for i in range(size)))))
            total += 1
        tail = words[len(words) - size + 1 :] if len(words) >= size else words
    if not total and tail:
        yield [b" ".join(tail)]


def _hashes(shingles: list[bytes], seed: int = SEED) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, seed) for s in shingles], np.uint64)


def _fingerprint(raw: bytes | None, size: int) -> np.ndarray:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    votes, total = np.zeros(64, np.int64), 0
    for shingles in _shingles(raw, size):
        votes += _votes(_hashes(shingles))
        total += len(shingles)
    return np.packbits(votes * 2 > total, bitorder="little").view(np.uint64)


def _votes(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return votes


def _distinct_shingles(raw: bytes | None, size: int) -> np.ndarray:
    """Hashes of a text's distinct shingles, in order."""
    hashes = [np.unique(_hashes(s)) for s in _shingles(raw, size)]
    return np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))


def _mixed(hashes: np.ndarray, word: int) -> np.ndarray:
    """Other hashes of the same, by the steps of SplitMix64."""
    x = hashes + np.uint64((word + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _print(shingles: np.ndarray) -> bytes:
    """The WIDE bits that distinct shingles vote for, then 128 bits that tell sets apart whose votes agree."""
    votes = np.stack([_votes(_mixed(shingles, word)) for word in range(WIDE // 64)])
    return np.packbits(votes * 2 > len(shingles), bitorder="little").tobytes() + xxhash.xxh3_128_digest(shingles.tobytes(), SEED)


def _least_shingles(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set that may be alike to one of fewer than SHORT shingles so many of the least that alike sets share one."""
    n = len(shingles)
    return shingles[: n - math.ceil(similarity * n - 1e-9) + 1 if n * similarity < SHORT else 0]


def _fingerprinted(rows: DataFrame, size: int) -> DataFrame:
    """Replace the first column, a text, by its fingerprint `fp`, a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [_fingerprint(raw, size) for raw in batch.column(0).to_pylist()]
            fps = pa.array(np.array(found, np.uint64).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([fps, *batch.columns[1:]], ["fp", *batch.schema.names[1:]])

    return _with_text_replaced(rows, run, "fp long")


def _printed(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Replace the first column, a text, by `fp` (see `_print`) and `short`, the shingles by which a short text is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [_distinct_shingles(raw, size) for raw in batch.column(0).to_pylist()]
            short = [_least_shingles(x, similarity).view(np.int64) for x in sets]
            columns = [pa.array([_print(x) for x in sets], pa.binary()), pa.array(short, pa.list_(pa.int64())), *batch.columns[1:]]
            yield pa.RecordBatch.from_arrays(columns, ["fp", "short", *batch.schema.names[1:]])

    return _with_text_replaced(rows, run, "fp binary, short array<long>")


def _with_text_replaced(rows: DataFrame, run, columns: str) -> DataFrame:
    text, *others = rows.columns
    schema = StructType([*StructType.fromDDL(columns), *[StructField(c, rows.schema[c].dataType) for c in others]])
    return rows.withColumn(text, F.col(text).cast("binary")).mapInArrow(run, schema)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5) -> DataFrame:
    """Per row `id_column` and `fp`, the 64-bit fingerprint as a long.

    Words are runs without ASCII white space, A-Z in lower case; a shingle is `size` words joined
    by spaces and counts as often as it occurs. Fewer words make one shingle; no word (null or
    empty text) gives 0.
    """
    rows = docs.select(F.col(text_column).alias("_text"), F.col(id_column).alias("_id"))
    return _fingerprinted(rows, size).select(F.col("_id").alias(id_column), "fp")


def _owner() -> np.ndarray:
    """For each set of unequal bands (as 8 bits) the one choice that emits the pair, else 255."""
    owner = np.full(256, 255, np.uint8)
    for choice in range(len(LEFT_OUT) - 1, -1, -1):
        a, b = LEFT_OUT[choice]
        owner[[0, 1 << a, 1 << b, 1 << a | 1 << b]] = choice
    return owner


def _ends(new: np.ndarray) -> np.ndarray:
    """Where the bucket of each row ends, from marks at each bucket's first row."""
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(new))
    return np.repeat(ends, ends - starts)


def _shared(new: np.ndarray) -> np.ndarray:
    """Rows of buckets that have another row."""
    last = np.append(new[1:], True)
    return ~(new & last)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows that come sorted by (choice, bucket); a bucket may span batches."""
    owner = _owner()
    masks = np.array([_mask(x) for x in LEFT_OUT], np.int64).view(np.uint64)

    def compare(choice: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = fps & masks[choice]
        new = np.ones(len(fps), bool)
        new[1:] = (choice[1:] != choice[:-1]) | (keys[1:] != keys[:-1])
        shared = _shared(new)
        choice, fps, new = choice[shared], fps[shared], new[shared]
        for one in np.unique(choice):
            rows = choice == one
            part = fps[rows]
            bits = [8 * band + bit for band in LEFT_OUT[one] for bit in range(8)]
            for i, j in close_pairs(part[:, None], _ends(new[rows]), RADIUS, bits):
                unequal = (part[i] ^ part[j]).view(np.uint8).reshape(-1, 8) != 0
                own = owner[np.packbits(unequal, axis=1, bitorder="little").ravel()] == one
                pair = [pa.array(part[x][own].view(np.int64)) for x in (i, j)]
                yield pa.RecordBatch.from_arrays(pair, ["a", "b"])

    held_choice, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        choice = np.concatenate([held_choice, batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)])
        fps = np.concatenate([held_fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(fps):
            continue
        keys = fps & masks[choice]
        last = (choice == choice[-1]) & (keys == keys[-1])
        cut = len(fps) - int(np.argmin(last[::-1])) if not last.all() else 0
        yield from compare(choice[:cut], fps[:cut])
        held_choice, held_fps = choice[cut:], fps[cut:]
    yield from compare(held_choice, held_fps)


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b) of the distinct fingerprints `fp` that differ in 1 or 2 bits, each once."""
    masks = F.array(*[F.lit(_mask(x)) for x in LEFT_OUT])
    choices = F.explode(F.sequence(F.lit(0), F.lit(len(LEFT_OUT) - 1)))
    rows = distinct.select(choices.alias("choice"), "fp")
    key = F.col("fp").bitwiseAND(F.get(masks, F.col("choice")))
    dealt = rows.repartition("choice", key).sortWithinPartitions("choice", key)
    return dealt.mapInArrow(_links, "a long, b long")


def _classed(prints: DataFrame, distinct: DataFrame, pairs: DataFrame, id_column: str, numbers: DataFrame | None = None) -> DataFrame:
    """The rows of `prints` with component_id, the least id of the class, and its root.

    `pairs` are of fingerprints; or of their numbers, given with them: a fingerprint without number is alone.
    """
    roots = components(pairs)
    if numbers is not None:
        roots = numbers.join(roots, F.col("number") == F.col("node")).select(F.col("fp").alias("node"), "root")
        least = roots.groupBy("root").agg(F.min("node").alias("least_print"))  # its class then goes by a fingerprint
        roots = stored(roots.join(least, "root").select("node", F.col("least_print").alias("root")))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = stored(
        classes.groupBy(F.col("root").alias("of")).agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows"))
    )
    members = least.select(F.col("of").alias("root"), "n_rows")
    ids = least.select("of", "component_id")
    named = stored(lookup(classes.select("fp", "root"), ids, {"root": "of"}, "inner", spread=["fp"], counts=members))
    return lookup(prints, named, {"fp": "fp"}, "inner", spread=[id_column], counts=distinct.select("fp", "n_rows"))


def _distinct(prints: DataFrame, id_column: str) -> DataFrame:
    more = [F.first(c).alias(c) for c in ("short",) if c in prints.columns]  # the same for equal fingerprints
    return stored(prints.groupBy("fp").agg(F.min(id_column).alias("least"), F.count("*").alias("n_rows"), *more))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5) -> DataFrame:
    """Per row: id, `fingerprint` (16 hex digits) and `component_id`, the least id of its class.

    Two texts are linked if their fingerprints differ in at most 2 bits; a class is all that
    can be reached. Texts without a word have fingerprint 0 and are linked like any other.
    Null ids count for no class's id unless it has no other, then component_id is null.
    Repeated rows stay repeated. Other columns of `docs` are not looked at.
    """
    prints = stored(fingerprints(docs, id_column, text_column, size))
    distinct = _distinct(prints, id_column)
    found = _classed(prints, distinct, links(distinct), id_column)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select(id_column, digits, "component_id")


def disagreement(similarity: float) -> float:
    """The part of the bits in which two texts of that Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _differing(similarity: float, deviations: float) -> float:
    """The part of the bits, so many standard deviations above what is expected."""
    q = disagreement(similarity)
    return q + deviations * math.sqrt(q * (1 - q) / WIDE)


def radius_for(similarity: float) -> int:
    return int(WIDE * _differing(similarity, RADIUS_AT))


def keys_for(similarity: float, rows: int) -> list[np.ndarray]:
    """The bits of each key: as many as make buckets of about BUCKET_ROWS, and so many keys that
    a pair at the similarity shares one with probability RECALL."""
    width = min(63, max(8, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))))
    found = (1 - _differing(similarity, FOUND_AT)) ** width
    random = np.random.default_rng(SEED)
    return [random.permutation(WIDE)[:width] for _ in range(_count(found))]


def _count(found: float) -> int:
    """How many keys find a pair with probability RECALL that one finds with probability `found`."""
    return math.ceil(math.log(1 - RECALL) / math.log(1 - found))


def further_keys(similarity: float, rows: int, choice: int, taken: np.ndarray) -> list[np.ndarray]:
    """The bits of each further key of a crowded bucket, none of which its own key has taken.

    As many bits as would make parts of about BUCKET_ROWS, and so many keys that a pair of the
    bucket shares a part with probability RECALL: all bits in which it differs are among the others.
    """
    width = min(40, max(1, math.ceil(math.log2(rows / BUCKET_ROWS))))
    left = np.setdiff1d(np.arange(WIDE), taken)
    found = (1 - _differing(similarity, FOUND_AT) * WIDE / len(left)) ** width
    random = np.random.default_rng([SEED, choice, width])
    return [random.permutation(left)[:width] for _ in range(_count(found))]


def _bits(column: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(flat, axis=1, bitorder="little")[:, :WIDE].astype(np.int64)


def _value(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    return bits[:, key] @ (np.int64(1) << np.arange(len(key), dtype=np.int64))


def _keyed(distinct: DataFrame, keys: list[np.ndarray]) -> DataFrame:
    """A row per fingerprint and key: choice, key (its bits), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            if not len(column):
                continue
            bits = _bits(column)
            for choice, some in enumerate(keys):
                columns = [pa.array(np.full(len(column), choice, np.int32)), pa.array(_value(bits, some)), column]
                yield pa.RecordBatch.from_arrays(columns, ["choice", "key", "fp"])

    return distinct.select("fp").mapInArrow(run, "choice int, key long, fp binary")


def _parted(similarity: float, keys: list[np.ndarray]):
    """Rows (choice, key, fp, n_rows) with their part: 0, or in a crowded bucket (n_rows given) one per further key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_rows = batch.column("n_rows").fill_null(0).to_numpy()
            whole = batch.filter(pa.array(n_rows == 0)).select(["choice", "key", "fp"])
            yield whole.append_column("part", pa.array(np.zeros(whole.num_rows, np.int64))).select(["choice", "key", "part", "fp"])
            choices = batch.column("choice").to_numpy()
            buckets = np.stack([choices, n_rows], axis=1)[n_rows > 0]
            for choice, n in np.unique(buckets, axis=0).tolist():
                rows = batch.filter(pa.array((choices == choice) & (n_rows == n)))
                bits = _bits(rows.column("fp"))
                for number, some in enumerate(further_keys(similarity, n, choice, keys[choice])):
                    part = pa.array(_value(bits, some) + ((number + 1) << 40))
                    columns = [rows.column("choice"), rows.column("key"), part, rows.column("fp")]
                    yield pa.RecordBatch.from_arrays(columns, ["choice", "key", "part", "fp"])

    return run


def _forests(radius: int):
    """Connecting pairs per bucket of rows sorted by (choice, key, part).

    A part of more than 2 * CROWD rows is compared in overlapping blocks of its order, in which
    rows that agree in more leading bits are neighbours; so memory and time a row are bounded.
    Choice -1, the shingles of short texts, is emitted as chains alone. Rows further apart in a crowded part
    are not compared here: neighbours of its order are all emitted as well, so the part becomes one block, in which `_rest` compares the shingles of all pairs
    that are still apart.
    """

    def compare(rows: pa.Table, crowded: bool) -> pa.RecordBatch:
        names = np.array(rows.column("fp").to_pylist(), object)
        marks = [rows.column(c).to_numpy() for c in ("choice", "key", "part")]
        new = np.ones(len(names), bool)
        new[1:] = np.any([m[1:] != m[:-1] for m in marks], axis=0)
        chained = marks[0] < 0
        if crowded:
            chained[: _ends(new)[0]] = True  # the crowded part leads
        nexts = np.flatnonzero(chained[1:] & ~new[1:])
        shared = np.flatnonzero(_shared(new) & (marks[0] >= 0))
        fps = np.frombuffer(b"".join(f[: WIDE // 8] for f in names[shared]), np.uint64).reshape(len(shared), WIDE // 64)
        i, j = nearest_forest(fps, _ends(new[shared]), radius) if len(fps) else (np.zeros(0, int), np.zeros(0, int))
        pair = [pa.array(names[x], pa.binary()) for x in (np.concatenate([shared[i], nexts]), np.concatenate([shared[j], nexts + 1]))]
        return pa.RecordBatch.from_arrays(pair, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, False
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while held.num_rows > 2 * CROWD:
                last = np.all([m == m[-1] for m in map(np.asarray, (held.column(c) for c in ("choice", "key", "part")))], axis=0)
                begun = 0 if last.all() else held.num_rows - int(np.argmin(last[::-1]))
                yield compare(held.slice(0, begun or 2 * CROWD), crowded or not begun)
                held, crowded = held.slice(begun or CROWD), not begun
        if held is not None and held.num_rows:
            yield compare(held, crowded)

    return run


def candidates(distinct: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the distinct wide fingerprints `fp` within the radius of the similarity.

    Enough to connect all close pairs that share a bucket; a pair may come more than once.
    Buckets of more than CROWD rows, as a large group of near copies makes, are dealt over
    tasks by several further keys each; what stays crowded is emitted as a chain, as are the texts
    that a shingle in `short` (if there is that column) belongs to.
    """
    keys = keys_for(similarity, distinct.count())
    keyed = _keyed(distinct, keys)
    crowded = stored(
        keyed.groupBy(F.col("choice").alias("c"), F.col("key").alias("k")).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > CROWD)
    )
    counts = crowded.select(F.col("c").alias("choice"), F.col("k").alias("key"), "n_rows")
    marked = lookup(keyed, crowded, {"choice": "c", "key": "k"}, "left", spread=["fp"], counts=counts)
    marked = marked.select("choice", "key", "fp", "n_rows")
    rows = marked.mapInArrow(_parted(similarity, keys), "choice int, key long, part long, fp binary")
    if "short" in distinct.columns:
        short = distinct.select(F.lit(-1).alias("choice"), F.explode("short").alias("key"), F.lit(0).cast("long").alias("part"), "fp")
        rows = rows.union(short)
    dealt = rows.repartition("choice", "key", "part").sortWithinPartitions("choice", "key", "part", "fp")
    return dealt.mapInArrow(_forests(radius_for(similarity)), "a binary, b binary")


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Per text its wide fingerprint and its distinct shingles, as sorted hashes of 32 bits."""
    for batch in slices(batches):
        sets = [_distinct_shingles(raw, size) for raw in batch.column(0).to_pylist()]
        prints = [_print(x) for x in sets]
        sets = [np.unique(x.astype(np.uint32)).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["fp", "shingles"])


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                a, b = np.frombuffer(left, np.uint32), np.frombuffer(right, np.uint32)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def _least_overlap(similarity: float, size):
    """How many shingles a set of that size shares at least with an alike one that is no smaller, and with one no larger."""
    ceil = lambda x: np.ceil(np.asarray(x) - 1e-9).astype(np.int64)
    return ceil(2 * similarity / (1 + similarity) * size), ceil(similarity * size)


def _slice_sets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of a slice one behind the other, their sizes, its distinct shingles, and each one's number among them."""
    sets = [np.frombuffer(x, np.uint32) for x in rows.column("shingles").to_pylist()]
    flat = np.concatenate([*sets, np.zeros(0, np.uint32)])
    distinct, number = np.unique(flat, return_inverse=True)
    return flat, np.array([len(x) for x in sets], np.int64), distinct, number


def _asked_counts(rows: pa.Table) -> pa.Table:
    """A slice's distinct shingles with their counts, dealt over as many buckets as its block has slices."""
    _, _, distinct, number = _slice_sets(rows)
    counts = np.bincount(number, minlength=len(distinct)).astype(np.uint32)
    n, block, at = (rows.column(c)[0].as_py() for c in ("n_slices", "block", "at"))
    bucket_of = (distinct % np.uint32(n)).astype(np.int64)
    dealt = np.argsort(bucket_of, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket_of[dealt])) + 1
    out = [
        (block, at, int(bucket_of[own[0]]), squeeze(distinct[own]), squeeze(counts[own]))
        for own in (np.split(dealt, cuts) if len(dealt) else [])
    ]
    kinds = [rows.schema.field("block").type, pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)]
    return pa.table(columns, ["block", "at", "bucket", "hashes", "counts"])


def _whole_counts(rows: pa.Table) -> pa.Table:
    """For each slice that asks: in how many texts of the whole block its shingles are."""
    hashes = [unsqueeze(x, np.uint32) for x in rows.column("hashes").to_pylist()]
    counts = [unsqueeze(x, np.uint32) for x in rows.column("counts").to_pylist()]
    number = np.unique(np.concatenate(hashes), return_inverse=True)[1]
    whole = np.bincount(number, weights=np.concatenate(counts))[number].astype(np.uint64)
    parts = np.split(whole, np.cumsum([len(h) for h in hashes])[:-1])
    return rows.drop_columns(["counts"]).append_column("counts", pa.array([squeeze(p) for p in parts], pa.binary()))


_POSTING = ["block", "shingle", "node", "root", "size", "place", "indexed"]


def _postings(similarity: float):
    """The shingles by which a text may meet an alike one: the rarest of its block first, so few texts share one.

    Of two alike texts the larger has a shingle among its first `size - overlap + 1` that the smaller has
    among its own; the smaller one needs fewer of them, which are marked as `indexed`.
    """

    def run(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        flat, sizes, distinct, number = _slice_sets(rows)
        found = answers.to_pylist()
        known = np.concatenate([*[unsqueeze(a["hashes"], np.uint32) for a in found], np.zeros(0, np.uint32)])
        counts = np.concatenate([*[unsqueeze(a["counts"], np.uint64) for a in found], np.zeros(0, np.uint64)])
        count = counts[np.argsort(known)][number]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((flat, count, owner))
        owner, flat, count = owner[order], flat[order], count[order]
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        no_smaller, no_larger = _least_overlap(similarity, sizes)
        keep = (place < (sizes - no_larger + 1)[owner]) & (count > 1)
        at = owner[keep]
        columns = [
            rows.column("block").take(pa.array(at)), pa.array(flat[keep].view(np.int32)), rows.column("node").take(pa.array(at)),
            rows.column("root").take(pa.array(at)), pa.array(sizes[at].astype(np.int32)), pa.array(place[keep].astype(np.int32)),
            pa.array((place < (sizes - no_smaller + 1)[owner])[keep]),
        ]
        return pa.table(columns, _POSTING)

    return run


def _met(postings: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different roots that a shingle brings together, as far as its places leave enough others to share.

    A shingle of many texts is dealt over tasks by its larger texts; the smaller ones are repeated there.
    """
    keys = ["block", "shingle"]
    probes = postings.drop("indexed").select(*keys, *[F.col(c).alias(f"p_{c}") for c in ("node", "root", "size", "place")])
    indexed = postings.where("indexed").select(*[F.col(c).alias(f"i_{c}") for c in ("block", "shingle", "node", "root", "size", "place")])
    hot = hot_keys(probes, keys, ["h_block", "h_shingle"])
    one = F.lit(0)
    probes, indexed = probes.withColumn("slot", one), indexed.withColumn("copy", one)
    if hot is not None:
        hot = hinted(hot.drop("_rows"))
        of = lambda side: (F.col(f"{side}block") == F.col("h_block")) & (F.col(f"{side}shingle") == F.col("h_shingle"))
        slot = F.coalesce(F.pmod(F.xxhash64("p_node"), F.col("_slots").cast("bigint")).cast("int"), one)
        probes = probes.join(hot, of(""), "left").withColumn("slot", slot).drop(*hot.columns)
        copies = F.explode(F.sequence(one, F.coalesce(F.col("_slots"), F.lit(1)) - 1))
        indexed = indexed.join(hot, of("i_"), "left").withColumn("copy", copies).drop(*hot.columns)
    sizes = F.col("p_size") + F.col("i_size")
    overlap = F.ceil(F.lit(similarity / (1 + similarity)) * sizes - 1e-9)
    most = 1 + F.least(F.col("p_size") - F.col("p_place"), F.col("i_size") - F.col("i_place")) - 1
    fits = (F.col("block") == F.col("i_block")) & (F.col("shingle") == F.col("i_shingle")) & (F.col("slot") == F.col("copy"))
    fits = fits & (F.col("p_root") != F.col("i_root")) & (F.col("i_size") <= F.col("p_size")) & (most >= overlap)
    pairs = probes.join(indexed, fits).select(F.least("p_node", "i_node").alias("a"), F.greatest("p_node", "i_node").alias("b"))
    return pairs.distinct()


def _rest(pairs: DataFrame, checked: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that `checked` lacks among the texts that `pairs` connect, all of them.

    A block is what `pairs` connect; texts that `checked` connects need no more links. In a block a prefix
    filter finds the pairs that may be alike: shingles ordered by how many texts of the block have them, of
    which alike texts share one of the first. These pairs are compared on their shingles.
    """
    blocks = components(pairs).select("node", F.col("root").alias("block"))
    roots = components(checked).select(F.col("node").alias("of"), F.col("root").alias("to"))
    members = blocks.join(roots, F.col("node") == F.col("of"), "left")
    members = stored(members.select("node", "block", F.coalesce("to", "node").alias("root")))
    parts = members.groupBy("block", "root").agg(F.count("*").alias("n"))
    parts = parts.groupBy(F.col("block").alias("of")).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_parts"))
    # both of a block of two have been compared
    left_open = stored(parts.where("n_parts > 1 AND n_rows > 2").drop("n_parts"))
    counts = left_open.select(F.col("of").alias("block"), "n_rows")
    rows = lookup(members, left_open.select("of"), {"block": "of"}, "left_semi", spread=["node"], counts=counts)
    rows = stored(rows.join(sets, F.col("node") == F.col("fp")).select("node", "block", "root", "shingles"))
    n_slices = F.ceil(F.greatest(F.lit(1), F.count("*") / SLICE_ROWS, F.sum(F.length("shingles")) / SLICE_BYTES)).cast("int")
    slices = stored(rows.groupBy(F.col("block").alias("of")).agg(n_slices.alias("n_slices")))
    rows = lookup(rows, slices, {"block": "of"}, "inner", spread=["node"], counts=counts)
    rows = stored(rows.withColumn("at", F.pmod(F.xxhash64("node"), F.col("n_slices")).cast("int")))
    kind = rows.schema["block"].dataType.simpleString()
    asked = rows.groupBy("block", "at").applyInArrow(_asked_counts, f"block {kind}, at int, bucket int, hashes binary, counts binary")
    counted = asked.groupBy("block", "bucket").applyInArrow(_whole_counts, f"block {kind}, at int, bucket int, hashes binary, counts binary")
    schema = f"block {kind}, shingle int, node {kind}, root {kind}, size int, place int, indexed boolean"
    postings = rows.groupBy("block", "at").cogroup(counted.groupBy("block", "at")).applyInArrow(_postings(similarity), schema)
    met = stored(_met(stored(postings), similarity))
    return _checked(met, rows.select("node", "shingles"), similarity)


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike; `sets` has a node and its shingles."""
    node, shingles = sets.columns
    left = sets.select(F.col(node).alias("fa"), F.col(shingles).alias("sa"))
    right = sets.select(F.col(node).alias("fb"), F.col(shingles).alias("sb"))
    with_left = lookup(pairs, left, {"a": "fa"}, "inner", spread=["b"])
    with_both = lookup(with_left, right, {"b": "fb"}, "inner", spread=["a"])
    kind = pairs.schema["a"].dataType.simpleString()
    return with_both.mapInArrow(_alike(similarity), f"a {kind}, b {kind}")


def similar(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """Per row: id, `fp` (its wide fingerprint and a hash of its distinct shingles), `component_id`, the least id of its class, and `root`.

    Texts whose distinct shingles have at least the given Jaccard similarity are linked, as far
    as their fingerprints share a bucket (see RECALL) or one of them has fewer than SHORT; a class is all that can be reached. Every
    link is checked on the shingles. Texts without a word are alike. Null ids, repeated rows and other columns as in `near_duplicates`.
    """
    rows = docs.select(F.col(text_column).cast("binary").alias("_text"), F.col(id_column).alias("_id"))
    prints = stored(_printed(rows, size, similarity).select(F.col("_id").alias(id_column), "fp", "short"))
    distinct = _distinct(prints, id_column)
    prints = prints.drop("short")
    pairs = candidates(distinct, similarity)
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = stored(pairs.select(F.col("a").alias("end")).union(pairs.select("b")).distinct())
    # from here on a fingerprint goes by a number
    numbers = distinct.join(ends, F.col("fp") == F.col("end"), "left_semi").select("fp", "least")
    numbers = stored(numbers.withColumn("node", F.monotonically_increasing_id()))
    number = numbers.select(F.col("fp").alias("of"), "node")
    for end in ("a", "b"):
        pairs = lookup(pairs, number.withColumnRenamed("node", "number"), {end: "of"}, "inner").drop(end).withColumnRenamed("number", end)
    pairs = stored(pairs.select("a", "b"))
    asked = numbers.select(F.col("least").alias("_least"))
    texts = rows.join(asked, F.col("_id") == F.col("_least"), "left_semi").union(rows.where("_id IS NULL")).select("_text")
    sets = texts.mapInArrow(lambda batches: _sets(batches, size), "fp binary, shingles binary")
    sets = sets.withColumnRenamed("fp", "_print").join(number, F.col("_print") == F.col("of")).select("node", "shingles")
    sets = stored(sets.groupBy("node").agg(F.min("shingles").alias("shingles")))
    checked = stored(_checked(pairs, sets, similarity))
    links = stored(checked.union(_rest(pairs, checked, sets.withColumnRenamed("node", "fp"), similarity)))
    return _classed(prints, distinct, links, id_column, numbers.select("fp", F.col("node").alias("number")))


def representatives(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """Of each class of `similar` texts the row of `docs` with the least id, all columns kept.

    Of rows repeated with the class's id the one whose columns hash lowest stays. A class
    without any id keeps the row whose columns hash lowest.
    """
    classes = stored(similar(docs, id_column, text_column, size, similarity).select(F.col(id_column).alias("_of"), "fp", "component_id", "root"))
    kept = classes.where(F.col("_of") == F.col("component_id")).select("component_id").distinct()
    rows = docs.select(F.col(text_column).alias("_text"), F.col(id_column).alias("_id"), F.struct("*").alias("_row"))
    first = F.row_number().over(Window.partitionBy("_id").orderBy(F.xxhash64("_row"))) == 1
    named = rows.join(kept, F.col("_id") == F.col("component_id"), "left_semi").withColumn("_first", first)

    without = classes.where("component_id IS NULL").select(F.col("fp").alias("_print"), "root").distinct()
    nameless = _printed(rows.where("_id IS NULL"), size, similarity).join(without, F.col("fp") == F.col("_print"))
    first = F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("_row"))) == 1
    nameless = nameless.withColumn("_first", first)
    return named.where("_first").select("_row").union(nameless.where("_first").select("_row")).select("_row.*")
