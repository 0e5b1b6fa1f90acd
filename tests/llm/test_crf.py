"""The chain against enumeration, and both classifiers on text they were not fitted on."""

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.frames import AWKWARD, SCHEMA, by_id, documents, prose
from viewloom.llm import crf, language_crf, quality_crf, secret_scan
from viewloom.llm.common import slices
from viewloom.llm.vocabulary import Vocabulary


def enumerated(scores, trans, start):
    """Node marginals, log normaliser and expected transitions by going through all paths."""
    n, states = scores.shape
    nodes, edges, total = np.zeros_like(scores), np.zeros((states, states)), 0.0
    for path in itertools.product(range(states), repeat=n):
        weight = np.exp(start[path[0]] + sum(scores[t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:])))
        total += weight
        for t, s in enumerate(path):
            nodes[t, s] += weight
        for a, b in zip(path, path[1:]):
            edges[a, b] += weight
    return nodes / total, np.log(total), edges / total


def test_forward_backward():
    random = np.random.default_rng(1)
    lengths = np.array([3, 1, 5, 2])
    scores, trans, start = random.normal(0, 3, (11, 3)), random.normal(0, 1, (3, 3)), random.normal(0, 1, 3)
    nodes, log_norm, edges = crf.marginals(scores, trans, start, crf.Steps.of(lengths), edges=True)
    parts = [enumerated(scores[e - n : e], trans, start) for n, e in zip(lengths, np.cumsum(lengths))]
    assert np.allclose(nodes, np.concatenate([p[0] for p in parts]))
    assert np.isclose(log_norm, sum(p[1] for p in parts)) and np.allclose(edges, sum(p[2] for p in parts))


def test_fit_learns_transitions():
    random = np.random.default_rng(2)
    gold = np.repeat(random.integers(0, 2, 60), 5)
    x = np.eye(2)[gold] + random.normal(0, 1.5, (300, 2))
    w, trans, _ = crf.fit(lambda w: x @ w, lambda g: x.T @ g, (2, 2), gold, np.full(6, 50), 200, 0.1, 1e-3)
    assert trans[0, 0] > trans[0, 1] and trans[1, 1] > trans[1, 0]
    steps = crf.Steps.of(np.full(6, 50))
    alone = (x @ w).argmax(axis=1) == gold
    assert (crf.marginals(x @ w, trans, np.zeros(2), steps).argmax(axis=1) == gold).mean() > alone.mean()


def junk(seed):
    kinds = [lambda w: " ".join(x + "***" for x in w), lambda w: " | ".join(w), lambda w: " ".join(x.upper() + "!!" for x in w)]
    return kinds[seed % 3](prose(seed, 60).split())


def test_quality(spark):
    good = [prose(s, 60) + ".\n" + prose(s + 500, 40) + "." for s in range(60)]
    bad = [junk(s) + "\n" + junk(s + 3) for s in range(60)]
    docs = documents(spark, good + bad).withColumn("score", F.lit(-1.0))
    ids = [(i, int(i < 60)) for i in range(120) if i % 4 != 2] + [(999, 1), (None, 0), (4, None)]
    labels = spark.createDataFrame(ids, "id long, good int")
    model = quality_crf.train(docs.select(F.col("doc_id").alias("id"), "text"), labels)
    scored = by_id(quality_crf.score(docs, model))
    assert all((scored[i].score >= 0.7) == (i < 60) for i in range(120))
    kept = quality_crf.accepted(docs, model, 0.7)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))
    odd = by_id(quality_crf.score(documents(spark, AWKWARD), model))
    assert len(odd) == len(AWKWARD) and all(0 <= r.score <= 1 for r in odd.values())
    assert odd[0].score == odd[1].score


def test_quality_blocks_do_not_matter(monkeypatch):
    random = np.random.default_rng(3)
    model = quality_crf.QualityModel(random.normal(0, 1, (quality_crf.FEATURES, 2)), random.normal(0, 1, (2, 2)), np.zeros(2))
    texts = [t for t in AWKWARD] + [prose(s, 20) + "\n" + junk(s) for s in range(9)]
    whole = model.score(texts)
    assert np.allclose(whole, [model.score([t])[0] for t in texts])
    monkeypatch.setattr(quality_crf, "BLOCK_LINES", 2)
    assert np.allclose(whole, model.score(texts))


def test_quality_without_labels(spark):
    docs = documents(spark, AWKWARD)
    model = quality_crf.train(docs.select(F.col("doc_id").alias("id"), "text"), spark.createDataFrame([], "id long, good int"))
    assert {r.score for r in quality_crf.score(docs, model).collect()} == {0.5}
    assert quality_crf.score(spark.createDataFrame([], SCHEMA), model).count() == 0


SYLLABLES = {"xx": ["ba", "do", "ki", "lo"], "yy": ["sch", "ung", "eit", "ver"], "zz": ["ción", "mente", "ado", "rr"]}


def speech(lang, seed, words):
    random = np.random.default_rng(seed)
    return " ".join("".join(random.choice(SYLLABLES[lang], random.integers(1, 4))) for _ in range(words))


def test_language(spark):
    rows = [(lang, speech(lang, s, 40)) for s in range(40) for lang in SYLLABLES]
    docs = spark.createDataFrame([(i, text, lang) for i, (lang, text) in enumerate(rows)], "id long, text string, lang string")
    model = language_crf.train(docs.where("id % 3 <> 1 OR id < 3").union(docs.select("id", "text", F.lit(None).alias("lang")).limit(2)))
    assert model.languages == sorted(SYLLABLES)
    got = by_id(language_crf.predict(docs, model, id_column="id"), "id")
    assert all(got[i].lang_pred == lang and got[i].score > 0.8 for i, (lang, _) in enumerate(rows))
    mixed = [speech("xx", 900, 30) + " " + speech("zz", 901, 20)]
    words = [language_crf.words_of(t) for t in mixed]
    states = model.word_marginals(words).argmax(axis=1)
    assert (states == [0] * 30 + [2] * (len(words[0]) - 30)).mean() > 0.95
    odd = by_id(language_crf.predict(documents(spark, AWKWARD + ["12 34 ²", "1a"]).withColumn("lang_pred", F.lit(1)), model))
    und = {i for i, r in odd.items() if r.lang_pred == "und"}
    assert und == {i for i, t in enumerate(AWKWARD + ["12 34 ²", "1a"]) if not any(map(str.isalpha, t or ""))}
    assert all(0 <= r.score <= 1 for r in odd.values())


def test_language_without_training(spark):
    model = language_crf.train(spark.createDataFrame([], "id long, text string, lang string"))
    docs = documents(spark, AWKWARD)
    assert {(r.lang_pred, r.score) for r in language_crf.predict(docs, model).collect()} == {("und", 0.0)}
    assert language_crf.predict(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_sample_is_bounded(spark):
    docs = documents(spark, [prose(s, 5) for s in range(50)]).withColumnRenamed("doc_id", "id")
    assert language_crf.sample(docs, 7).count() == 7
    labels = docs.select("id", (F.col("id") % 2).alias("good"))
    assert quality_crf.sample(docs.select("id", "text"), labels, 7).count() == 14


def test_repeats_are_remembered_over_a_very_long_text():
    """A line that comes again after 300,000 varied words still counts as repeated."""
    line = b"one two three four five six".decode()
    own, _ = quality_crf.line_features("\n".join([line, *(f"w{k} x{k} y{k} z{k} v{k} u{k}" for k in range(50_000)), line]))
    assert own[0, 11] == 0 and own[-1, 11] == 1 and own[-1, 12] > 0.7


def test_long_sequences_in_blocks():
    """Blocks give the marginals that one step after the other gives."""
    random = np.random.default_rng(5)
    for states, lengths in ((2, [1, 2, 7, 8, 9, 40, 33, 5]), (4, [100]), (3, [16, 17, 1])):
        lengths = np.array(lengths)
        scores, trans, start = random.normal(0, 3, (lengths.sum(), states)), random.normal(0, 2, (states, states)), random.normal(0, 1, states)
        want = crf.marginals(scores, trans, start, crf.Steps.of(lengths))
        assert np.allclose(crf.sequence_marginals(scores, trans, start, lengths, block=4), want, atol=1e-9)
    long = np.array([300_000])
    found = crf.sequence_marginals(random.normal(0, 1, (300_000, 2)), np.eye(2), np.zeros(2), long)
    assert np.allclose(found.sum(axis=1), 1)


def test_a_text_travels_once_and_in_slices(spark):
    """What a worker holds does not grow by a second copy of each text, nor with the session's rows per batch."""
    docs = documents(spark, [*AWKWARD, prose(1, 50)])
    model = quality_crf.QualityModel(np.zeros((quality_crf.FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    for found in (quality_crf.accepted(docs, model, 0.5), secret_scan.redacted(docs, Vocabulary())):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        sent = next(line for line in plan.split("MapInArrow", 1)[1].split("\n")[1:] if "Project" in line)
        assert sent.count("text") == 2, sent  # a field's name and its value
        assert sorted(r.doc_id for r in found.collect()) == list(range(len(AWKWARD) + 1)) and found.columns == docs.columns
    batch = pa.RecordBatch.from_pydict({"n": list(range(1000)), "text": ["x" * 90] * 1000})
    some = list(slices(iter([batch]), 5000))
    assert len(some) > 15 and max(b.nbytes for b in some) <= 5000 and pa.Table.from_batches(some).equals(pa.Table.from_batches([batch]))
    assert [b.num_rows for b in slices(iter([batch.slice(0, 3), batch.slice(0, 0)]), 1)] == [1, 1, 1]
