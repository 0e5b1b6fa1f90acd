"""Encoding against the tokenizer itself, and an exact round trip."""

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents, prose
from viewloom.llm import bpe, word_blocks
from viewloom.llm.vocabulary import Vocabulary

TEXTS = AWKWARD + ["don't  stop\n\n  I'LL we'll''s 123abc 4²５", "日本語 テキスト 🙂🙂 <|endoftext|>", " \u2003\u3000 x", prose(1, 500), "a\u0301\u0308 ﬁ Ω≈ç", "!?" * 400]


@pytest.mark.parametrize("block", [200, 1 << 25])
def test_same_as_tokenizer(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "PART_WORDS", block // 20)
    docs = documents(spark, TEXTS * 2).repartition(3, "doc_id").withColumns({"tokens": F.lit(1), "block": F.lit(0), "_row": F.lit(0)})
    vocabulary = Vocabulary()
    encoding = vocabulary.encoding()
    got = by_id(bpe.decode(bpe.encode(docs, vocabulary, buckets=5), vocabulary))
    assert len(got) == 2 * len(TEXTS)
    for i, text in enumerate(TEXTS * 2):
        assert list(got[i].tokens) == encoding.encode_ordinary(text or "")
        assert bytes(got[i].decoded) == (text or "").encode()


def test_long_text_in_parts(monkeypatch):
    pattern, text = regex.compile(Vocabulary().pattern), prose(3, 5000)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    assert [w for some in bpe.pre_tokens(text, pattern) for w in some] == pattern.findall(text)


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])
    rows = sorted((r.doc_id or 0, len(r.tokens)) for r in bpe.encode(docs, Vocabulary()).collect())
    assert rows == [(0, 0), (0, 1), (1, 2), (1, 2)]


def test_unknown_ids_and_nulls(spark):
    rows = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "id int, tokens array<int>")
    got = by_id(bpe.decode(rows, Vocabulary()), "id")
    assert got[2].decoded is None and bytes(got[3].decoded) == b"" and len(got[1].decoded) == 2
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([60000],)], "tokens array<int>"), Vocabulary()).collect()


def test_empty(spark):
    assert bpe.decode(bpe.encode(spark.createDataFrame([], SCHEMA), Vocabulary()), Vocabulary()).count() == 0


def test_packing():
    import numpy as np

    for kind in (np.uint8, np.uint32, np.uint64):
        for size in (0, 1, 1000):
            values = np.random.default_rng(size).integers(0, 200, size).astype(kind)
            assert np.array_equal(word_blocks.unsqueeze(word_blocks.squeeze(values), kind), values)
    words = [b"", b"a", "ü".encode() * 50, b"a"]
    assert word_blocks.unsqueeze_words(*word_blocks.squeeze_words(words)) == words


def test_one_pass_over_the_texts(spark, tmp_path):
    """Both readers of the blocks share one shuffle, so the texts are cut once."""
    documents(spark, TEXTS).write.parquet(str(tmp_path / "docs"))
    encoded = bpe.encode(spark.read.parquet(str(tmp_path / "docs")), Vocabulary())
    encoded.write.format("noop").mode("overwrite").save()
    plan = encoded._jdf.queryExecution().executedPlan()
    encoded.collect()
    assert "ReusedExchange" in encoded._jdf.queryExecution().executedPlan().toString(), plan
