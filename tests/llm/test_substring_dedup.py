"""Cut passages against a plain search, with tiny blocks, few buckets and short automata."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.frames import AWKWARD, SCHEMA, documents, prose
from viewloom.llm import substring_dedup as sd


def plain(texts, size):
    """(id, n_words, n_removed, kept) for texts in the order of their ids."""
    seen, out = set(), []
    for key, text in texts:
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = True
            seen.add(window)
        out.append((key, len(words), int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def texts(size):
    shared, other = prose(1, 2 * size + 3), prose(2, size)
    out = [*AWKWARD, prose(3, 30) + " " + shared + " " + prose(4, 11), prose(5, 7) + " " + shared, shared, shared + " " + other + " " + shared]
    out += [other, " ".join(other.split()[:-1]), other + " tail", "head " + other, "\n".join(other.split())]
    out += ["a " * (size + 2), "a " * 5 * size, "a b " * 3 * size, "b a " * size, "a b c " * size, "x y " * size + "x z"]
    out += [prose(seed, 6 * size, 3) for seed in range(6, 12)]  # few words: many windows recur by chance
    out += [out[12]] * 3 + [prose(40, 3000), prose(40, 3000)[5000:9000], "ä" * 3000 + " " + shared.replace("a", "é"), shared.replace("a", "é")]
    return out


@pytest.mark.parametrize("size", [20, 3])
def test_same_as_plain_search(size):
    """The steps on blocks of their own, without Spark between them."""
    rows = [(i * 37 % 101, t) for i, t in enumerate(texts(size))]
    for limit, buckets in ((1, 3), (2000, 1), (1 << 20, 5)):
        assert cut_by_hand(rows, size, limit, buckets) == {key: rest for key, *rest in plain(sorted(rows), size)}


def cut_by_hand(rows, size, limit, buckets):
    old, sd.BLOCK_BYTES = sd.BLOCK_BYTES, limit
    chars, sd.PATTERN_CHARS = sd.PATTERN_CHARS, 300
    try:
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([(r[1] or "").encode() for r in rows])], ["id", "text"])
        blocks = pa.Table.from_batches(list(pack(batch)))
        ask = sorted((r for b in sd._asked_anchors(buckets, size)(iter(blocks.to_batches())) for r in b.to_pylist()), key=lambda r: (r["bucket"], r["block"]))
        shared = answers(sd._shared_anchors, ask, "block long, bucket int, hashes binary")
        some = lambda rows, k: pa.Table.from_pylist([r for r in rows if r["block"] == k], ANSWER)
        one = lambda k: blocks.filter(pa.compute.equal(blocks["block"], k))
        numbers = blocks["block"].to_pylist()
        ask = sorted((r for k in numbers for r in sd._asked_windows(buckets, size)(None, one(k), some(shared, k)).to_pylist()), key=lambda r: (r["bucket"], r["block"]))
        both = [{**r, "step": 1} for r in shared] + [{**r, "step": 2} for r in answers(sd._earlier_windows, ask, None)]
        out = [r for k in numbers for r in sd._cut(buckets, size)(None, one(k), some(both, k)).to_pylist()]
        return {r["id"]: [r["n_words"], r["n_removed"], r["kept"].decode()] for r in out}
    finally:
        sd.BLOCK_BYTES, sd.PATTERN_CHARS = old, chars


ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary()), ("step", pa.int32())])


def answers(step, asked, _):
    batches = pa.Table.from_pylist(asked).to_batches(max_chunksize=4) if asked else []
    return [r for b in step(iter(batches)) for r in b.to_pylist()]


def pack(batch):
    class Rows:
        schema = {"id": type("", (), {"dataType": sd.LongType()})}

        def mapInArrow(self, run, schema):
            return run(iter([batch]))

    class Task:
        @staticmethod
        def get():
            return type("", (), {"partitionId": lambda self: 2})()

    old, sd.TaskContext = sd.TaskContext, Task
    try:
        yield from sd._blocks(Rows())
    finally:
        sd.TaskContext = old


def test_through_spark(spark):
    rows = [(i * 37 % 101, t) for i, t in enumerate(texts(20))]
    docs = documents(spark, rows).repartition(4).withColumnRenamed("lang", "id").withColumnRenamed("source", "block")
    out = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in sd.deduplicated(docs, buckets=3).collect())
    assert out == plain(sorted(rows), 20)


def test_null_and_repeated_ids(spark):
    """A null id comes first; of rows repeated as a whole one keeps its words."""
    text = prose(1, 50)
    docs = documents(spark, [(4, text), (None, text), (4, text), (9, text + " " + text)]).coalesce(1)
    out = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in sd.deduplicated(docs).collect())
    assert out == [(-1, 50, 0), (4, 50, 50), (4, 50, 50), (9, 100, 100)]
    docs = documents(spark, [(4, text), (4, text)]).coalesce(1)
    assert sorted(r.n_removed for r in sd.deduplicated(docs).collect()) == [0, 50]


def test_empty(spark):
    assert sd.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0
