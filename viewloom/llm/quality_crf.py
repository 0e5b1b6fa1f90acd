"""Quality classifier: a conditional random field over the lines of a document.

Every line is good or bad. A line's features are its own, those of the lines before and
after it, and what it repeats of the text so far; forward-backward gives the marginal of
good per line, and their mean weighted by length is the quality of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from viewloom.llm.common import position, slices
from viewloom.llm.crf import fit, sequence_marginals

SYMBOLS = b"#*$%&<>~^"
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
OWN = 15
FEATURES = 3 * OWN + 1
GRAM = 4
#: The classifier is fitted on so many labelled documents of each class, and lines of each, at most.
SAMPLE, SAMPLE_LINES = 1500, 256
ROUNDS, RATE, PENALTY = 250, 0.05, 1e-4
BLOCK_LINES, BLOCK_TEXTS = 20_000, 2000


def _counts(raw: bytes, some: bytes) -> int:
    return len(raw) - len(raw.translate(None, some))


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """OWN features per line, and the weight (length) per line; a text has at least one line.

    Repetition looks back over the whole text: its lines and word groups are remembered as 64-bit hashes,
    so memory follows the one text in hand.
    """
    rows, weights, lines, grams = [], [], set(), set()
    for raw in (text or "").encode().split(b"\n"):
        words = raw.split()
        n, size = len(words), len(raw)
        groups = list(map(hash, zip(*(words[i:] for i in range(GRAM)))))
        known = sum(map(grams.__contains__, groups))
        inside = len(groups) - len(set(groups))
        grams.update(groups)
        line = hash(raw)
        upper, lower = _counts(raw, UPPER), _counts(raw, LOWER)
        joined = sum(a == b for a, b in zip(words, words[1:]))
        rows.append((
            min(np.log1p(n), 8.0) / 4,
            min(_counts(raw, SYMBOLS) / (n + 1), 3.0),
            min(raw.count(b"|") / (n + 1), 2.0),
            min(raw.count(b"!") / (n + 1), 2.0),
            upper / (upper + lower + 1),
            _counts(raw, DIGITS) / (size + 1),
            min(size / (n + 1), 30.0) / 10,
            joined / (n + 1),
            len(set(words)) / (n + 1),
            n >= 30 and len(set(words)) < 0.55 * n,
            raw.rstrip().endswith((b".", b"?")),
            n > 0 and line in lines,
            known / (len(groups) + 1),
            inside / (len(groups) + 1),
            n == 0,
        ))
        lines.add(line)
        weights.append(size + 1)
    return np.array(rows, np.float32), np.array(weights, np.float64)


def in_context(own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Own features, those of the previous and of the next line of the same text, and a constant."""
    ends = np.cumsum(lengths)
    out = np.zeros((len(own), FEATURES), np.float32)
    out[:, :OWN] = own
    out[1:, OWN : 2 * OWN] = own[:-1]
    out[:-1, 2 * OWN : 3 * OWN] = own[1:]
    out[ends - lengths, OWN : 2 * OWN] = 0
    out[ends - 1, 2 * OWN : 3 * OWN] = 0
    out[:, -1] = 1
    return out


@dataclass
class QualityModel:
    """State 1 is good. Without any labelled document all weights are 0 and every score is 0.5."""

    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def line_marginals(self, own: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        scores = in_context(own, lengths).astype(np.float64) @ self.weights
        return sequence_marginals(scores, self.trans, self.start, lengths)[:, 1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, own, weights, held = [], [], [], 0

        def flush() -> None:
            lengths = np.array([len(x) for x in own])
            good = self.line_marginals(np.concatenate(own), lengths)
            flat, first = np.concatenate(weights), np.cumsum(lengths) - lengths
            out.append(np.add.reduceat(good * flat, first) / np.add.reduceat(flat, first))
            own.clear()
            weights.clear()

        for text in texts:
            features, sizes = line_features(text)
            own.append(features)
            weights.append(sizes)
            held += len(features)
            if held > BLOCK_LINES or len(own) >= BLOCK_TEXTS:
                flush()
                held = 0
        if own:
            flush()
        return np.clip(np.concatenate(out), 0.0, 1.0) if out else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` labelled documents of each class: id, text, good.

    `labels` has `id` and `good`; of several labels for one id a bad one counts. The choice
    goes by a hash of the id, so it does not depend on the order of rows.
    """
    known = labels.where("id IS NOT NULL AND good IS NOT NULL").groupBy("id").agg(F.min("good").alias("good"))
    pool = docs.select("id").join(known, "id", "inner")
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [pool.where(F.col("good") == good).orderBy(*order).limit(most) for good in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # 2 * most rows of two numbers
    return docs.join(few, "id", "inner")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> QualityModel:
    """Fit on a bounded sample. `docs` has `id` and `text`, `labels` has `id` and `good` (1 or 0).

    Every line of a document has the document's label. The features of the sampled lines
    come to the driver: 2 * most documents of at most SAMPLE_LINES lines. Rows without id or label are not
    learned from, a null text is one empty line, repeated rows are learned from as often as they come.
    Other columns are not looked at. Without any labelled row every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [line_features(text)[0][:SAMPLE_LINES] for text in batch.column(1).to_pylist()]
            packed = pa.array([x.tobytes() for x in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed], ["id", "good", "own"])

    kind = docs.schema["id"].dataType.simpleString()
    rows = sample(docs.select("id", "text"), labels.select("id", F.col("good").cast("int").alias("good")), most)
    rows = rows.select("id", "text", "good").mapInArrow(run, f"id {kind}, good int, own binary").collect()
    rows.sort(key=lambda r: (r["id"], r["good"], bytes(r["own"])))
    own = [np.frombuffer(bytes(r["own"]), np.float32).reshape(-1, OWN) for r in rows]
    lengths = np.array([len(x) for x in own], np.int64)
    if not len(own):
        return QualityModel(np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    x = in_context(np.concatenate(own), lengths).astype(np.float64)
    gold = np.repeat([r["good"] for r in rows], lengths)
    found = fit(lambda w: x @ w, lambda g: x.T @ g, (FEATURES, 2), gold, lengths, ROUNDS, RATE, PENALTY)
    return QualityModel(*found)


def score(docs: DataFrame, model: QualityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id and `score`, 0 to 1. A null text counts as empty and is scored as one empty line.

    Repeated rows stay repeated; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = pa.array(model.score(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["id", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_column), "score")


def accepted(docs: DataFrame, model: QualityModel, least: float, text_column: str = "text") -> DataFrame:
    """The rows of `docs` whose score is at least `least`, all columns kept, whatever their names.

    A null or empty text is scored as one empty line. Repeated rows go or stay together; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = model.score(batch.column(0).field(text).to_pylist()) >= least
            yield batch.filter(pa.array(keep, pa.bool_()))

    text = position(docs, text_column)  # read from the row, so that a text travels once
    rows = docs.select(F.struct("*").alias("_row"))
    return rows.mapInArrow(run, rows.schema).select("_row.*")
