"""Byte-level BPE encoding and decoding over a global shuffle of distinct words.

Texts are cut into pre-tokens with their positions. All occurrences of a pre-token meet, one
per block of texts, in one task, which encodes it once; the ids join back to the blocks and
are reassembled by position. Decoding joins the token-byte table, whose size the vocabulary
bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from viewloom.llm.vocabulary import Vocabulary
from viewloom.llm.word_blocks import (
    BLOCK_BYTES, Block, block_number, buckets_for, gather, meet, schema_of, squeeze, texts_of, unsqueeze,
    unsqueeze_words, words_by_bucket,
)

LONG_TEXT = 1 << 20
PART_WORDS = 1 << 19


def pre_tokens(text: str | None, pattern) -> Iterator[list[str]]:
    """All matches of the pattern; those of a long text in lists of bounded size."""
    if not text:
        return
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    matches = pattern.finditer(text)
    while some := [m.group() for m in islice(matches, 1 << 16)]:
        yield some


def _pack(docs: DataFrame, id_column: str, text_column: str, vocabulary: Vocabulary, buckets: int) -> DataFrame:
    pattern_text = vocabulary.pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern, block, held, count = regex.compile(pattern_text), Block(), 0, 0
        partition, id_type = TaskContext.get().partitionId(), None
        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if held and held + len(text or "") > BLOCK_BYTES:
                    yield from block.batches(block_number(partition, count), buckets, id_type)
                    block, held, count = Block(), 0, count + 1
                block.add(key, pre_tokens(text, pattern))
                held += len(text or "") + 1
        if held:
            yield from block.batches(block_number(partition, count), buckets, id_type)

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, schema_of(rows.schema["id"]))


def _encode_words(vocabulary: Vocabulary):
    """Per row of words, the ids of each; a word is encoded once, however many blocks hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, now, known = vocabulary.encoding(), None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    now, known = row["bucket"], {}
                found = []
                for word in unsqueeze_words(row["sizes"], row["words"]):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encoding.encode_ordinary(word.decode())
                    found.append(ids)
                sizes = np.array([len(x) for x in found], np.uint32)
                flat = np.array([i for x in found for i in x], np.uint32)
                out.append((row["block"], row["numbers"], squeeze(sizes), squeeze(flat)))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), *[pa.binary()] * 3])] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, ["block", "places", "sizes", "tokens"])

    return run


def _reassemble(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
    row = texts_of(texts)
    parts = answers.to_pylist()
    places = np.concatenate([unsqueeze(p["places"], np.uint32) for p in parts] or [np.zeros(0, np.uint32)])
    sizes = np.concatenate([unsqueeze(p["sizes"], np.uint32) for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
    flat = np.concatenate([unsqueeze(p["tokens"], np.uint32) for p in parts] or [np.zeros(0, np.uint32)])
    at = np.empty(len(places), np.int64)
    at[places] = np.arange(len(places))  # where the answer for a place lies
    numbers = unsqueeze(row["numbers"], np.uint32)
    ends = np.cumsum(unsqueeze(row["sizes"], np.uint32).astype(np.int64))
    lists, first = [], 0
    while first < len(ends):  # some texts at a time: positions take many times the room of ids
        begin = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, begin + PART_WORDS, side="right")))
        tokens, taken = gather(flat, sizes, at[numbers[begin : ends[last - 1]]])
        sums = np.concatenate([[0], np.cumsum(taken)])[np.concatenate([[0], ends[first:last] - begin])]
        lists.append(pa.ListArray.from_arrays(pa.array(sums, pa.int32()), pa.array(tokens.astype(np.int32))))
        first = last
    ids = texts.column("ids").combine_chunks().filter(pa.compute.less(texts.column("bucket"), 0).combine_chunks())
    return pa.table([ids.flatten(), pa.chunked_array(lists, pa.list_(pa.int32()))], names=["id", "tokens"])


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """Per row: id and `tokens`, the ids of the whole text in order.

    A null or empty text has no tokens. Repeated rows stay repeated; other columns are not
    looked at. `docs` should come from a table (see word_blocks).
    """
    if buckets is None:
        size = docs.agg(F.sum(F.octet_length(text_column))).first()[0] or 0
        buckets = buckets_for(docs.sparkSession, size)
    dealt = meet(_pack(docs, id_column, text_column, vocabulary, buckets))
    answers = words_by_bucket(dealt).mapInArrow(
        _encode_words(vocabulary), "block long, places binary, sizes binary, tokens binary"
    )
    kind = docs.schema[id_column].dataType.simpleString()
    joined = dealt.groupBy("block").cogroup(answers.groupBy("block"))
    found = joined.applyInArrow(_reassemble, f"id {kind}, tokens array<int>")
    return found.select(F.col("id").alias(id_column), "tokens")


def decode(encoded: DataFrame, vocabulary: Vocabulary, tokens_column: str = "tokens") -> DataFrame:
    """Add `decoded`, the bytes of the tokens; null for null. An unknown id fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = vocabulary.ranks()
        size = max(ranks.values(), default=-1) + 1
        words = [b""] * size
        for word, number in ranks.items():
            words[number] = word
        lengths = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_tokens"))
            out = []
            for one in lists:
                if not one.is_valid:
                    out.append(None)
                    continue
                ids = one.values.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= size or not lengths[ids].all()):
                    raise ValueError("a token id is not in the vocabulary")
                out.append(gather(flat, lengths, ids)[0].tobytes())
            rest = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_tokens"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.binary())], [*others, "_decoded"])

    others = ["_row"]
    rows = encoded.select(F.struct("*").alias("_row"), F.col(tokens_column).cast("array<int>").alias("_tokens"))
    kind = rows.schema["_row"].dataType.simpleString()
    found = rows.mapInArrow(run, f"_row {kind}, _decoded binary")
    return found.select("_row.*", F.col("_decoded").alias("decoded"))
