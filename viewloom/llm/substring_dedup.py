"""Substring dedup: passages of at least SIZE words that occurred earlier are cut out of every text.

1. A task packs its texts into blocks of numbered words (word_blocks), one stored row a block.
2. Candidates. Every window of SIZE words is known by the least hash of the short word groups in it;
   neighbouring windows mostly share it, so a block has few. These are dealt over `buckets`, and a
   bucket tells each block which of its hashes another block has as well, in one bit each.
3. Confirmation. Windows whose least hash recurs go to the buckets by 96-bit hashes, each once a
   block with its first place there; the bucket answers which of them start earlier elsewhere.
4. A block joins its confirmed windows to the longest passages that occur as a whole wherever a part
   of them does, compiles them into Aho-Corasick automata of bounded size, and streams its
   documents through them. Every occurrence but the first of all is cut out.

So automata are sharded by documents: a block's hold what recurs in its own texts, however much
that is elsewhere. A passage that all documents share is asked for once a block, and memory follows
the block and the bucket. Only hashes, one place per window and bits travel besides the packed texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from viewloom.llm.common import raw_words
from viewloom.llm.word_blocks import block_number, squeeze, squeeze_words, unsqueeze, unsqueeze_words
from viewloom.operators.staging import stored

SIZE = 20
GROUP = 8  # words whose hash may stand for a window
BLOCK_BYTES = 8 << 20
BUCKET_WORDS = 2_500_000  # words of all texts per bucket, about
PATTERN_CHARS = 1 << 20  # characters in one automaton
PASSAGE = 2000  # windows in one passage

_BLOCK = ["block", "n_words", "ids", "sizes", "numbers", "word_sizes", "words"]


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block of texts: ids, and the texts as numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, held, id_type = TaskContext.get().partitionId(), 0, 0, None
        index, ids, sizes, codes = {}, [], [], []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate([*codes, np.zeros(0, np.uint32)])
            word_sizes, joined = squeeze_words(list(index))
            row = (block_number(partition, number), len(flat), ids, squeeze(np.array(sizes, np.uint32)), squeeze(flat), word_sizes, joined)
            kinds = [pa.int64(), pa.int64(), pa.list_(id_type), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], _BLOCK)

        for batch in batches:
            id_type = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw, size = raw or b"", 0
                if ids and held + len(raw) > BLOCK_BYTES:
                    yield flush()
                    index, ids, sizes, codes, held, number = {}, [], [], [], 0, number + 1
                for some in raw_words(raw):
                    codes.append(np.array([index.setdefault(w, len(index)) for w in some], np.uint32))
                    size += len(some)
                ids.append(key)
                sizes.append(size)
                held += len(raw) + 16
        if ids:
            yield flush()

    kinds = [LongType(), LongType(), ArrayType(rows.schema["id"].dataType), *[BinaryType()] * 4]
    return rows.mapInArrow(run, StructType([StructField(n, k) for n, k in zip(_BLOCK, kinds)]))


def _mix(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """An ordered combination of two arrays of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(step * 0xC2B2AE3D27D4EB4F % (1 << 64)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _windows(of_words: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """The hash of the `size` words from each place on, by doubling: parts of 1, 2, 4, ... words."""
    part, reach, out, done = of_words, 1, None, 0
    while True:
        if size & reach:
            out = part if out is None else _mix(out[: len(part) - done], part[done:], step + 100 + reach)
            done += reach
        if 2 * reach > size:
            return out[: max(0, len(of_words) - size + 1)]
        part = _mix(part[: len(part) - reach], part[reach:], step + reach)
        reach *= 2


def _least(values: np.ndarray, reach: int) -> np.ndarray:
    """The least of `reach` values from each place on."""
    part, done = values, 1
    while 2 * done <= reach:
        part = np.minimum(part[: len(part) - done], part[done:])
        done *= 2
    rest = reach - done
    return np.minimum(part[: len(part) - rest], part[rest:]) if rest else part


class _Texts:
    """The texts of a block, put in the order of ids, and the hashes of their windows."""

    def __init__(self, row: dict, size: int):
        self.size = size
        sizes = unsqueeze(row["sizes"], np.uint32).astype(np.int64)
        keys = [(k is not None, k or 0) for k in row["ids"]]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        starts = np.cumsum(sizes) - sizes
        self.ids = [row["ids"][k] for k in self.order]
        self.sizes = sizes[self.order]
        self.starts = np.cumsum(self.sizes) - self.sizes
        flat = unsqueeze(row["numbers"], np.uint32)
        self.codes = flat[np.repeat(starts[self.order] - self.starts, self.sizes) + np.arange(len(flat))]
        self.words = unsqueeze_words(row["word_sizes"], row["words"])
        #: places at which a window starts, in the order of ids
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inside = np.arange(len(flat)) + size <= np.repeat(self.starts + self.sizes, self.sizes)
        self.at = np.flatnonzero(inside)

    def _hashes(self, seed: int) -> np.ndarray:
        of_words = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in self.words], np.uint64)
        return of_words[self.codes]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Per window the least hash of its groups of words; and hashes that recur inside one window's reach."""
        group = min(GROUP, self.size)
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        groups = _windows(self._hashes(1), group)
        near = [groups[d:][groups[d:] == groups[:-d]] for d in range(1, self.size - group + 1)]
        return _least(groups, self.size - group + 1)[self.at], np.unique(np.concatenate([*near, np.zeros(0, np.uint64)]))

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        x, y = (_windows(self._hashes(seed), self.size, seed)[self.at] for seed in (2, 3))
        return x, (y >> np.uint64(32)).astype(np.uint32)


def _distinct_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of hashes: where each distinct one comes first, and for each pair the number of its distinct one."""
    order = np.argsort(x, kind="stable")
    same = x[order[1:]] == x[order[:-1]]
    if (y[order[1:]] != y[order[:-1]])[same].any():  # one half agrees by chance
        order = np.lexsort((y, x))
        same = (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
    new = np.append(True, ~same) if len(order) else np.zeros(0, bool)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _anchors_of(texts: _Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors of a block ascending, whether windows of each may recur in the block, and each window's anchor's number.

    Equal windows have their anchor at the same place in them. So either the anchor recurs within the
    reach of a window, or equal windows lie in two runs of windows with that anchor, or in one that is
    longer than an anchor at one place makes.
    """
    anchors, near = texts.anchors()
    distinct, number = np.unique(anchors, return_inverse=True)
    new = np.ones(len(anchors), bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (np.diff(texts.at) > 1)
    twice = np.bincount(number[new], minlength=len(distinct)) > 1
    lengths = np.diff(np.append(np.flatnonzero(new), len(anchors)))
    twice[number[new][lengths > texts.size - min(GROUP, texts.size) + 1]] = True
    return distinct, twice | np.isin(distinct, near), number


def _rows(block: int, bucket_of: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple]:
    """(block, bucket, packed columns) for each bucket, in the order of the columns."""
    dealt = np.argsort(bucket_of, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket_of[dealt])) + 1
    for places in np.split(dealt, cuts) if len(dealt) else []:
        yield (block, int(bucket_of[places[0]]), *[squeeze(c[places]) for c in columns])


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)]
    return pa.RecordBatch.from_arrays(columns, names)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes % np.uint64(buckets)).astype(np.int64)


def _asked_anchors(buckets: int, size: int):
    """Every block's distinct anchors, as differences of ascending hashes; 48 bits are enough to find candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct = _anchors_of(_Texts(row, size))[0]
                bucket_of = _bucket_of(distinct, buckets)
                dealt = np.argsort(bucket_of, kind="stable")
                short = distinct[dealt] >> np.uint64(16)
                same = np.diff(bucket_of[dealt]) == 0
                short[1:] -= np.where(same, short[:-1], 0).astype(np.uint64)  # a bucket begins with the hash itself
                short[dealt] = short.copy()
                yield _batch(list(_rows(row["block"], bucket_of, [short])), ["block", "bucket", "hashes"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after another, from rows sorted by bucket."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's hashes in a bucket: a bit, set where another block has the hash."""
    for rows in _by_bucket(batches):
        parts = [np.cumsum(unsqueeze(r["hashes"], np.uint64), dtype=np.uint64) for r in rows]
        number = np.unique(np.concatenate(parts), return_inverse=True)[1]
        many = (np.bincount(number) > 1)[number]
        ends = np.cumsum([len(p) for p in parts])
        bits = [squeeze(np.packbits(m)) for m in np.split(many, ends[:-1])]
        yield _batch([(r["block"], r["bucket"], b) for r, b in zip(rows, bits)], ["block", "bucket", "bits"])


def _answered(bucket_of: np.ndarray, answers: list[dict]) -> np.ndarray:
    """The bits of all buckets, put in the order of the hashes that were asked."""
    out = np.zeros(len(bucket_of), bool)
    dealt = np.argsort(bucket_of, kind="stable")
    first = np.searchsorted(bucket_of[dealt], [a["bucket"] for a in answers])
    last = np.searchsorted(bucket_of[dealt], [a["bucket"] for a in answers], side="right")
    for answer, begin, end in zip(answers, first, last):
        out[dealt[begin:end]] = np.unpackbits(unsqueeze(answer["bits"], np.uint8), count=int(end - begin)).astype(bool)
    return out


def _candidates(texts: _Texts, answers: list[dict], buckets: int) -> tuple[np.ndarray, ...]:
    """The windows that may recur: their places and numbers; and per distinct one, numbered by first place, that first window and its hashes."""
    distinct, twice, number = _anchors_of(texts)
    recurs = twice | _answered(_bucket_of(distinct, buckets), answers)
    may = np.flatnonzero(recurs[number]) if len(number) else np.zeros(0, np.int64)
    x, y = (h[may] for h in texts.hashes())
    first, which = _distinct_pairs(x, y)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    first = first[order]
    return texts.at[may], rank[which], first, x[first], y[first]


_WINDOW = ["block", "bucket", "x", "y", "known", "ids", "starts"]


def _asked_windows(buckets: int, size: int):
    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _Texts(blocks.to_pylist()[0], size)
        at, _, first, x, y = _candidates(texts, answers.to_pylist(), buckets)
        owner = texts.owner[at[first]]
        known = np.array([k is not None for k in texts.ids], np.uint8)[owner]
        ids = np.array([k or 0 for k in texts.ids], np.int64)[owner]
        starts = (at[first] - texts.starts[owner]).astype(np.uint32)
        rows = _rows(blocks.column("block")[0].as_py(), _bucket_of(x, buckets), [x, y, known, ids, starts])
        return pa.Table.from_batches([_batch(list(rows), _WINDOW)])

    return run


def _earlier_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block's windows in a bucket: a bit, set where the window starts earlier in another block."""
    kinds = {"x": np.uint64, "y": np.uint32, "known": np.uint8, "ids": np.int64, "starts": np.uint32}
    for rows in _by_bucket(batches):
        parts = {c: [unsqueeze(r[c], kind) for r in rows] for c, kind in kinds.items()}
        sizes = [len(p) for p in parts["x"]]
        block = np.repeat([r["block"] for r in rows], sizes)
        x, y, known, ids, starts = (np.concatenate(parts[c]) for c in kinds)
        order = np.lexsort((starts, block, ids, known, y, x))
        later = np.zeros(len(order), bool)
        later[order[1:]] = (x[order[1:]] == x[order[:-1]]) & (y[order[1:]] == y[order[:-1]])
        bits = [squeeze(np.packbits(m)) for m in np.split(later, np.cumsum(sizes)[:-1])]
        yield _batch([(r["block"], r["bucket"], b) for r, b in zip(rows, bits)], ["block", "bucket", "bits"])


def passages(
    at: np.ndarray, which: np.ndarray, first: np.ndarray, owner: np.ndarray, later: np.ndarray, most: int = PASSAGE
) -> Iterator[tuple[int, int]]:
    """(window, windows) of the passages that the confirmed windows of a block make up.

    `at` and `owner` are the place and text of each candidate window, `which` its number, `first` per number
    the first candidate that has it, `later` whether it starts earlier in another block. Neighbours are joined
    if every occurrence of the one is followed by the other, which has no more of them, and both are
    alike in `later`; so a passage occurs as a whole wherever any window of it does.
    """
    count = np.bincount(which, minlength=len(first))
    confirmed = later | (count > 1)
    after = np.zeros(len(at), bool)
    after[:-1] = (np.diff(at) == 1) & (owner[at[1:]] == owner[at[:-1]])
    joined = after[first]
    next_one = np.where(joined, which[np.minimum(first + 1, len(at) - 1)], -1) if len(first) else first
    followed = after.copy()
    followed[:-1] &= which[1:] == next_one[which[:-1]]
    joined &= np.bincount(which, weights=followed, minlength=len(first)) == count
    joined &= next_one == np.arange(len(first)) + 1
    joined[:-1] &= (count[1:] == count[:-1]) & (later[1:] == later[:-1]) & confirmed[1:]
    begin = None
    for window in np.flatnonzero(confirmed).tolist():
        if begin is not None and not (joined[window - 1] and end == window and window - begin < most):
            yield begin, end - begin
            begin = None
        begin, end = window if begin is None else begin, window + 1
    if begin is not None:
        yield begin, end - begin


def _removed(texts: _Texts, found: Iterator[tuple[int, int]], places: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Which words of the block go: automata of the passages, one after the other, go through all texts."""
    words = [w.decode(errors="surrogateescape") for w in texts.words]
    edges = np.zeros(len(texts.codes) + 1, np.int64)
    text_of = lambda begin, n: f" {' '.join([words[c] for c in texts.codes[begin : begin + n].tolist()])} "
    lines = [text_of(a, n) if n >= texts.size else "" for a, n in zip(texts.starts.tolist(), texts.sizes.tolist())]

    def stream(automaton: ahocorasick.Automaton) -> None:
        automaton.make_automaton()
        for line, start in zip(lines, texts.starts.tolist()):
            blanks = None
            for end, (size, n, place, gone) in automaton.iter(line) if line else ():
                if blanks is None:
                    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
                begin = start + int(np.searchsorted(blanks, end - size + 1))
                if gone or begin != place:
                    edges[begin] += 1
                    edges[begin + n] -= 1

    automaton, held = ahocorasick.Automaton(), 0
    for window, n in found:
        place, n = int(places[window]), n + texts.size - 1
        pattern = text_of(place, n)
        if held and held + len(pattern) > PATTERN_CHARS:
            stream(automaton)
            automaton, held = ahocorasick.Automaton(), 0
        automaton.add_word(pattern, (len(pattern), n, place, bool(later[window])))
        held += len(pattern)
    if held:
        stream(automaton)
    return np.cumsum(edges[:-1]) > 0


def _cut(buckets: int, size: int):
    """Per text of a block: id, n_words, n_removed and the words that stay."""

    def run(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        row = blocks.to_pylist()[0]
        texts, answers = _Texts(row, size), answers.to_pylist()
        at, which, first, x, _ = _candidates(texts, [a for a in answers if a["step"] == 1], buckets)
        later = _answered(_bucket_of(x, buckets), [a for a in answers if a["step"] == 2])
        gone = _removed(texts, passages(at, which, first, texts.owner, later), at[first], later)
        cut = np.add.reduceat(np.append(gone, False).astype(np.int64), texts.starts) if len(texts.starts) else texts.sizes
        cut = np.where(texts.sizes > 0, cut, 0).astype(np.int64)
        kept = []
        for start, n in zip(texts.starts.tolist(), texts.sizes.tolist()):
            codes = texts.codes[start : start + n][~gone[start : start + n]]
            kept.append(b" ".join([texts.words[c] for c in codes.tolist()]))
        columns = [pa.array(texts.ids, blocks.schema.field("ids").type.value_type), pa.array(texts.sizes), pa.array(cut), pa.array(kept, pa.binary())]
        return pa.table(columns, ["id", "n_words", "n_removed", "kept"])

    return run


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, buckets: int | None = None
) -> DataFrame:
    """Per row: id, n_words, n_removed and `kept`, the words that stay, joined by one space.

    A word goes if a window of `size` words that covers it also starts earlier: in a row with a smaller id,
    or earlier in the same row. Windows are judged on the input, and compared by the exact bytes of their words
    (by hashes of 96 bits); words are runs without ASCII white space. Ids are whole numbers; a null id comes first,
    and rows with the same id follow each other as they were read, so a repeated row goes but for its first copy. A null or empty text, or one
    of fewer words than a window, is kept as it is. Other columns are not looked at. Memory follows
    BLOCK_BYTES, or the longest text. `size` is at least 2.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("binary").alias("text"))
    blocks = stored(_blocks(rows))
    if buckets is None:
        words = blocks.agg(F.sum("n_words")).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET_WORDS))
    by_bucket = lambda asked: asked.repartition("bucket").sortWithinPartitions("bucket", "block")
    asked = blocks.mapInArrow(_asked_anchors(buckets, size), "block long, bucket int, hashes binary")
    shared = stored(by_bucket(asked).mapInArrow(_shared_anchors, "block long, bucket int, bits binary"))
    schema = "block long, bucket int, x binary, y binary, known binary, ids binary, starts binary"
    asked = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_asked_windows(buckets, size), schema)
    earlier = by_bucket(asked).mapInArrow(_earlier_windows, "block long, bucket int, bits binary")
    answers = shared.withColumn("step", F.lit(1)).union(earlier.withColumn("step", F.lit(2)))
    kind = docs.schema[id_column].dataType.simpleString()
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _cut(buckets, size), f"id {kind}, n_words long, n_removed long, kept binary"
    )
    return found.select(F.col("id").alias(id_column), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
