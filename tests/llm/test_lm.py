"""Scores against plain counts, normalisation, and held-out gain where context tells something."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents, prose
from viewloom.llm import neural_lm, word_blocks

TEXTS = AWKWARD + [prose(s, 80, 30) for s in range(20)] + ["Word word WORD Ärger ärger", "never seen before"]


def fitted(spark, texts, classes=None, rounds=1):
    learn = documents(spark, texts).select("text")
    counts = neural_lm.count(learn, classes)
    return counts, neural_lm.train(learn, counts, rounds)


@pytest.mark.parametrize("block", [300, 1 << 25])
def test_base_score(spark, monkeypatch, block):
    monkeypatch.setattr(neural_lm, "BLOCK_BYTES", block)
    monkeypatch.setattr(neural_lm, "TRIPLES_BYTES", block)
    train = TEXTS[:-1]
    counts, model = fitted(spark, train, classes=10)
    tokens = [[*(t or "").encode().lower().split(), b""] for t in TEXTS]
    c = Counter(w for words in tokens[:-1] for w in words)
    n, v = sum(c.values()), len(c)
    assert (counts.tokens, counts.distinct) == (n, v)
    docs = documents(spark, TEXTS).withColumns({"score": F.lit(1), "n_known": F.lit("x")})
    got = by_id(neural_lm.score(docs, counts, model, buckets=4))
    for i, words in enumerate(tokens):
        assert (got[i].n_tokens, got[i].n_known) == (len(words), sum(c[w] > 0 for w in words))
        assert math.isclose(got[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
        assert math.isclose(got[i].score, plain_score(words, model, counts, c), rel_tol=1e-5)


def plain_score(words, model, counts, c):
    """Word by word, normalised over all sections and over the classes of one."""
    total, before = 0.0, [len(model.context) - 1] * neural_lm.CONTEXT
    log_share = lambda scores, k: scores[k] - np.log(np.exp(scores - scores.max()).sum()) - scores.max()
    for w in words:
        k = model.classes([w])[0]
        vector = sum(model.context[b] * model.position[i] for i, b in enumerate(before))
        one = int(model.section[k])
        lo, hi = model.cuts[one], model.cuts[one + 1]
        total += log_share(np.float64(model.top @ vector + model.top_bias), one) / math.log(10)
        total += log_share(np.float64(model.output[lo:hi] @ vector + model.bias[lo:hi]), k - lo) / math.log(10)
        if k >= len(model.index):
            total += math.log10((c[w] + neural_lm.ALPHA) / counts.group_norms()[k - len(model.index)])
        before = [*before[1:], k]
    return total


def test_probabilities_sum_to_one(spark):
    counts, model = fitted(spark, TEXTS, classes=20)
    classes = np.arange(len(model.output))
    for context in ([0, 3], [len(model.context) - 1] * 2):
        assert math.isclose((10 ** model.log10(np.tile(context, (len(classes), 1)), classes)).sum(), 1, rel_tol=1e-5)
    known = {bytes(r.word): r.c for r in counts.words.collect()}
    for g, norm in enumerate(counts.group_norms()):
        rare = [n for w, n in known.items() if model.classes([w]) == [len(model.index) + g]]
        assert math.isclose((sum(rare) + 0.1 * (len(rare) + 1)) / norm, 1)


def test_classes_grow_with_the_words(spark, monkeypatch):
    """Twice the square root of the distinct words are classes of their own, long ones too; the others share by ending."""
    monkeypatch.setattr(neural_lm, "LEAST_SINGLES", 1)
    long = "l" * 500
    texts = [f"{long} " * 50] + [" ".join(f"w{k}x{s}" for k in range(100)) for s in range(40)]
    counts = neural_lm.count(documents(spark, texts).select("text"))
    assert counts.distinct == 4002 and len(counts.frequent) == 127 and len(counts.grouped) == 32
    model = neural_lm.initial(counts)
    assert max(map(len, model.index)) <= neural_lm.LONGEST and model.classes([long.encode()])[0] < 2
    assert model.classes([b"qq3x7", b"zzzx7"])[0] == model.classes([b"zzzx7"])[0] >= 127


def test_context_helps_on_unseen_text(spark):
    random = np.random.default_rng(5)
    words = {k: [f"{k}{i}" for i in range(12)] for k in "abc"}
    texts = [" ".join(random.choice(words["abc"[s % 3]], 120)) for s in range(90)]
    counts, model = fitted(spark, texts[:60], rounds=2)
    got = neural_lm.score(documents(spark, texts[60:]), counts, model).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.85 * got[1]  # log-probabilities: nearer to 0


def test_repeated_rows_and_null_ids(spark):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])
    counts, model = fitted(spark, ["a b", "b"])
    rows = sorted((r.doc_id or 0, r.n_tokens) for r in neural_lm.score(docs, counts, model).collect())
    assert rows == [(0, 1), (0, 2), (1, 3), (1, 3)]


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    counts = neural_lm.count(empty.select("text"))
    model = neural_lm.train(empty.select("text"), counts)
    got = neural_lm.score(documents(spark, ["a b", None]), counts, model).collect()
    assert all(abs(r.base_score) < 1e-9 and abs(r.score) < 1e-5 and r.n_known == 0 for r in got) and len(got) == 2
    assert neural_lm.score(empty, counts, model).count() == 0


def test_a_context_is_predicted_once(spark, monkeypatch):
    """However many words and sections follow a context; and steps of any size say the same."""
    counts, model = fitted(spark, TEXTS, classes=20)
    contexts = np.array([[0, 1], [3, 2], [0, 1]]).repeat(len(model.output), axis=0)
    targets = np.tile(np.arange(len(model.output)), 3)
    seen, predicted = [], neural_lm.Model.predicted
    monkeypatch.setattr(neural_lm.Model, "predicted", lambda self, some: seen.append(len(some)) or predicted(self, some))
    found = model.log10(contexts, targets)
    assert sum(seen) == 2 and np.allclose(np.power(10, found).reshape(3, -1).sum(axis=1), 1, atol=1e-5)
    assert np.allclose(found, model.log10(contexts, targets, step=1), rtol=1e-5)


def test_contexts_of_short_texts():
    classes, starts = np.array([5, 6, 7, 8, 9]), np.array([0, 1, 2])
    assert neural_lm.contexts_of(classes, starts, 99).tolist() == [[99, 99], [99, 99], [99, 99], [99, 7], [7, 8]]


@pytest.mark.parametrize("size, cut", [(1, 8), (40, 5), (None, 1 << 20)])
def test_words_are_numbered_once(size, cut):
    """Whatever the slabs and however a text is cut, all its words come in order; a slab holds each distinct one once."""
    texts = [*(t if t is None else t.encode() for t in TEXTS), b"\x85a\xa0 \xff\x1cB\x0bc\x00\n", b"a b " * 50, b" " * 30, b" x" + b" " * 30]
    items = []
    for numbers, words in word_blocks.numbered_words(texts, size, cut):
        listed = word_blocks.words_of(words)
        assert listed == words.to_pylist() and len(set(listed)) == len(listed)
        items += [listed[n] for n in numbers]
    assert items == [w for t in texts for w in [*(t or b"").lower().split(), b""]]


def test_classes_are_found_for_distinct_words(spark, monkeypatch):
    """Not once per word of the texts, and as word by word: frequent, long, shared and unknown ones."""
    long = b"l" * 500
    counts, _ = fitted(spark, [long.decode() + " a b c"] * 3 + TEXTS, classes=10)
    model, asked = neural_lm.initial(counts), []
    classes = neural_lm.Model.classes
    monkeypatch.setattr(neural_lm.Model, "classes", lambda self, words: asked.append(len(words)) or classes(self, words))
    texts = [long + b" the the x"] * 40 + [None, b"", "Ärger ä y".encode()]
    found, starts = neural_lm._classes_of(texts, model)
    words = [w for t in texts for w in [*(t or b"").lower().split(), b""]]
    assert asked == [len(set(words))]
    known = {neural_lm.known_as(w): i for i, (w, _) in enumerate(counts.frequent)}
    group = lambda w: len(known) + zlib.crc32(w[-neural_lm.ENDING :]) % model.groups
    assert found.tolist() == [known.get(neural_lm.known_as(w), group(w)) for w in words]
    assert starts.tolist() == [0, *[i + 1 for i, w in enumerate(words) if not w][:-1]]
