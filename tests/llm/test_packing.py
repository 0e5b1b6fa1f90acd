"""Packing against a plain best fit, and that every token is placed once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents
from viewloom.llm import packing
from viewloom.llm.vocabulary import Vocabulary

SIZES = (8, 16, 64)


def plain(lengths, capacities):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for k, length in enumerate(lengths):
        fitting = [(room, b) for b, (room, _) in enumerate(bins) if room >= length]
        if fitting:
            b = min(fitting)[1]
        else:
            size = packing.opened(length, sum(lengths[k + 1 :]), capacities)
            b = len(bins)
            bins.append([size, size])
        out.append((b, bins[b][1] - bins[b][0]))
        bins[b][0] -= length
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit(seed):
    random = np.random.default_rng(seed)
    lengths = sorted(random.integers(1, 65, random.integers(0, 300)).tolist(), reverse=True)
    assert packing.best_fit(lengths, SIZES) == plain(lengths, SIZES)


def test_opened_looks_ahead():
    sizes = (512, 8192)
    assert packing.opened(300, 0, sizes) == 512  # nothing follows: the small bin
    assert packing.opened(513, 0, sizes) == 8192


def frame(spark, lengths):
    return spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n_tokens long")


@pytest.mark.parametrize("group_rows", [30, 10_000])
def test_every_token_once(spark, group_rows):
    random = np.random.default_rng(1)
    lengths = [*random.integers(0, 200, 300).tolist(), 0, 64, 128, 1, 63, 65, None]
    docs = frame(spark, lengths).withColumns({"bin": F.lit("x"), "_pack": F.lit(1)})
    rows = packing.pack(docs, capacities=SIZES, group_rows=group_rows).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.piece))
        bins.setdefault((r.pack, r.bin), []).append((r.offset, r.length, r.capacity))
    for i, n in enumerate(lengths):
        at = 0
        for k, (start, length, piece) in enumerate(sorted(pieces.get(i, []))):
            assert (start, piece) == (at, k)
            at += length
        assert at == (n or 0)
    for held in bins.values():
        at = 0
        for offset, length, capacity in sorted(held):
            assert offset == at and length > 0
            at += length
        assert len({c for _, _, c in held}) == 1 and held[0][2] == min(c for c in SIZES if c >= at)
    again = packing.pack(docs.repartition(7), capacities=SIZES, group_rows=group_rows).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_repeated_rows_and_null_ids_spread(spark):
    docs = spark.createDataFrame([(None, 5)] * 400 + [(7, 9)] * 400, "doc_id long, n_tokens long")
    rows = packing.pack(docs, capacities=SIZES, group_rows=40).collect()
    assert len(rows) == 800 and len({r.pack for r in rows if r.doc_id == 7}) > 10 and sum(r.length for r in rows) == 400 * 14


def test_lengths(spark):
    vocabulary = Vocabulary()
    encoding = vocabulary.encoding()
    got = by_id(packing.token_lengths(documents(spark, AWKWARD).withColumn("n_tokens", F.lit("x")), vocabulary))
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(encoding.encode_ordinary(t or "")) + 1 for i, t in enumerate(AWKWARD)}


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert packing.pack(packing.token_lengths(docs, Vocabulary())).count() == 0
