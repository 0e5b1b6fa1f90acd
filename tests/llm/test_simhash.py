"""SimHash against all pairs."""

from functools import cache

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents, prose
from viewloom.llm import bitslice, simhash


def fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys, linked):
    least = {k: k for k in keys}
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if linked(a, b)]
    before = None
    while least != before:
        before = dict(least)
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


@pytest.mark.parametrize("bits,radius", [(64, 2), (64, 9), (256, 50)])
def test_close_pairs(bits, radius):
    random = np.random.default_rng(bits + radius)
    base = random.integers(0, 1 << 63, (9, bits // 64), np.uint64)
    fps = base[random.integers(0, 9, 300)]
    for row in fps:
        for b in random.integers(0, bits, random.integers(0, radius + 3)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    end = np.repeat([1, 3, 90, 190, 300], [1, 2, 87, 100, 110])
    got = {(i, j) for a, b in bitslice.close_pairs(fps, end, radius) for i, j in zip(a.tolist(), b.tolist())}
    distance = lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j]).sum())
    want = {(i, j) for i in range(300) for j in range(i + 1, end[i]) if distance(i, j) <= radius}
    assert got == want and len(want) > 300
    left, right = bitslice.nearest_forest(fps, end, radius)
    tree = set(zip(left.tolist(), right.tolist()))
    assert tree <= want and len(tree) < 300
    near = lambda pairs: classes(range(300), lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert near(tree) == near(want)


def chain(fp, steps):
    """Texts cannot be made to order, so links are tested on fingerprints."""
    out = [fp]
    for b in steps:
        out.append(out[-1] ^ (1 << b[0]) ^ (1 << b[1]))
    return out


def test_links_are_all_pairs(spark):
    random = np.random.default_rng(3)
    fps = {0, (1 << 64) - 1}
    for fp in random.integers(0, 1 << 63, 60).tolist():
        fps.update(chain(fp, random.integers(0, 64, (random.integers(0, 6), 2)).tolist()))
    base = int(random.integers(0, 1 << 62))
    fps.update(base ^ b for b in range(0, 1 << 16, 97))  # one crowded bucket
    fps = sorted(fps)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 2}
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == want


def test_near_duplicates(spark):
    texts = AWKWARD + [prose(1, 40), prose(1, 40).upper(), prose(2, 3), prose(2, 2), "word", "WORD"]
    got = by_id(simhash.near_duplicates(documents(spark, texts).withColumn("fp", F.lit("x")), size=3))
    prints = {i: fingerprint(t, 3) for i, t in enumerate(texts)}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    want = classes(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: r.component_id for i, r in got.items()} == want


def test_long_text_in_parts(monkeypatch):
    text = prose(5, 4000)
    whole = fingerprint(text, 5)
    parts = simhash.raw_words
    monkeypatch.setattr(simhash, "raw_words", lambda raw: parts(raw, 100))
    assert int(simhash._fingerprint(text.encode(), 5)[0]) == whole


@cache
def shingles(text):
    words = text.lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    both = len(shingles(a) & shingles(b))
    return both / (len(shingles(a)) + len(shingles(b)) - both)


def edited(text, seed, part):
    random, words = np.random.default_rng(seed), text.split()
    for i in random.choice(len(words), max(1, int(part * len(words))), replace=False):
        words[i] = f"new{i}"
    return " ".join(words)


def similar_classes(spark, texts, **more):
    return by_id(simhash.similar(documents(spark, texts), **more))


def test_similar_finds_copies_and_leaves_others(spark, monkeypatch):
    texts = []
    for seed in range(30):
        base = prose(seed, 200)
        texts += [base, edited(base, seed, 0.01), edited(base, seed + 100, 0.02), edited(base, seed, 0.3)]
    texts += [edited(texts[0], 1000 + k, 0.01) for k in range(150)]  # a large group
    monkeypatch.setattr(simhash, "CROWD", 40)
    got = similar_classes(spark, texts)
    want = classes(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    wrong = [i for i in want if got[i].component_id != want[i]]
    assert len(wrong) <= 2, wrong
    linked = {i for i in want if want[i] != i}
    assert len(linked) > 180 and all(got[i].component_id == i for i in range(3, 120, 4))


def test_links_that_other_close_pairs_stand_in_for(spark, monkeypatch):
    """A forest first - second - third, of which both pairs fail the check, does not hide that the first and third are alike."""
    base = prose(40, 200)
    texts = [base, edited(base, 1, 0.05), edited(base, 2, 0.01)]

    def chained(distinct, similarity):
        fps = [r.fp for r in distinct.orderBy("least").collect()]
        return spark.createDataFrame(list(zip(fps, fps[1:])), "a binary, b binary")

    monkeypatch.setattr(simhash, "candidates", chained)
    assert jaccard(texts[0], texts[2]) >= 0.8 > max(jaccard(texts[0], texts[1]), jaccard(texts[1], texts[2]))
    assert [r.component_id for _, r in sorted(similar_classes(spark, texts).items())] == [0, 1, 0]


def test_crowded_buckets_keep_close_pairs(spark, monkeypatch):
    """Pairs in one crowded bucket, 15% of the bits apart, are still connected."""
    random = np.random.default_rng(8)
    ones = random.integers(0, 2, (600, simhash.WIDE), np.uint8)
    ones[:, :8] = 0  # the only key finds one bucket
    twos = ones.copy()
    for row in twos:
        row[random.choice(np.arange(8, simhash.WIDE), 38, replace=False)] ^= 1
    fps = [np.packbits(x, bitorder="little").tobytes() for x in np.concatenate([ones, twos])]
    monkeypatch.setattr(simhash, "CROWD", 200)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", 100)
    monkeypatch.setattr(simhash, "keys_for", lambda similarity, rows: [np.arange(8)])
    out = simhash.candidates(spark.createDataFrame([(bytearray(x),) for x in fps], "fp binary"), 0.8).collect()
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in out}
    assert sum(frozenset(p) in found for p in zip(fps[:600], fps[600:])) >= 0.97 * 600


def test_what_stays_crowded_is_one_block(monkeypatch):
    """Rows of one part, further apart than a window, are connected; other parts are left alone."""
    monkeypatch.setattr(simhash, "CROWD", 16)
    random = np.random.default_rng(9)
    part = np.repeat([0, 1, 2], [3, 150, 5])
    fps = [random.integers(0, 256, simhash.WIDE // 8, np.uint8).tobytes() for _ in part]
    columns = [pa.array(np.zeros(len(part), np.int32)), pa.array(np.zeros(len(part), np.int64)), pa.array(part), pa.array(fps, pa.binary())]
    rows = pa.table(columns, ["choice", "key", "part", "fp"])
    out = simhash._forests(53)(iter(rows.to_batches(max_chunksize=40)))
    pairs = {p for batch in out for p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
    linked = classes(range(len(fps)), lambda a, b: (fps[a], fps[b]) in pairs)
    assert linked == {k: 3 if 3 <= k < 153 else k for k in range(len(fps))}


def test_repeated_and_few_shingles(spark):
    """Repeats do not count, a shingle in majority does not stand for the text, short texts are found for certain."""
    line = " " + " ".join(f"l{k}" for k in range(10))
    texts = [prose(70, 300) + line, prose(70, 300) + line * 30]
    texts += ["same word " * 60 + prose(71, 6), "same word " * 60 + prose(72, 6)]
    for seed in range(100, 180):
        base = prose(seed, 8 + seed % 20, 3000)
        texts += [base, base + " more"]
    got = similar_classes(spark, texts)
    want = classes(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert want[1] == 0 and want[3] == 3 and sum(want[i] != i for i in want) > 70
    assert [i for i in want if got[i].component_id != want[i]] == []


def test_the_rest_is_compared(spark, monkeypatch):
    """Close pairs that all fail, in a chain, say only which texts to compare."""
    monkeypatch.setattr(simhash, "SLICE_ROWS", 3)
    sets = [np.arange(100), np.arange(40, 140), np.arange(5, 105), np.arange(45, 145), np.arange(300, 400), np.arange(8, 108)]
    names = [bytes([65 + k]) for k in range(len(sets))]
    rows = [(n, x.astype(np.uint32).tobytes()) for n, x in zip(names, sets)]
    shingles = spark.createDataFrame([(n, bytearray(x)) for n, x in rows], "fp binary, shingles binary")
    pairs = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in zip(names, names[1:])], "a binary, b binary")
    out = simhash._rest(pairs, pairs.limit(0), shingles, 0.8).collect()
    found = {frozenset((bytes(r.a), bytes(r.b))) for r in out}
    linked = classes(names, lambda a, b: frozenset((a, b)) in found)
    assert linked == {b"A": b"A", b"B": b"B", b"C": b"A", b"D": b"B", b"E": b"E", b"F": b"A"}


def test_representatives(spark):
    base = prose(9, 100)
    texts = [(4, base), (2, edited(base, 1, 0.01)), (3, base), (3, base), (7, prose(10, 100)), (None, prose(11, 50)),
             (None, prose(11, 50)), (None, base), (8, None), (9, ""), (10, "  ")]
    docs = documents(spark, texts).withColumns({"fp": F.lit(1), "root": F.lit("r"), "_id": F.lit(0)})
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted(
        [(2, texts[1][1]), (7, prose(10, 100)), (0, prose(11, 50)), (8, "")]
    )


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(docs).count() == 0 and simhash.representatives(docs).count() == 0


def test_lone_rows_share_no_bucket():
    """A task whose rows share no bucket emits no pair, whatever the choices."""
    fps = [bytes([k]) * (simhash.WIDE // 8) + b"rest" for k in range(20)]
    for n, choice in ((0, 0), (1, 0), (2, 0), (20, 0), (20, -1)):
        columns = [pa.array(np.full(n, choice, np.int32)), pa.array(np.arange(n)), pa.array(np.zeros(n, np.int64)), pa.array(fps[:n], pa.binary())]
        rows = pa.table(columns, ["choice", "key", "part", "fp"])
        assert sum(batch.num_rows for batch in simhash._forests(53)(iter(rows.to_batches()))) == 0


@pytest.mark.parametrize("n", [1, 2, 20])
def test_unlike_texts_stay(spark, n):
    docs = documents(spark, [prose(200 + k, 200, 3000) for k in range(n)])
    assert simhash.representatives(docs).count() == n
