"""Language ID: a conditional random field labels every word of a text with a language.

A word's features are its character n-grams with word edges (so affixes are among them) and,
if the lexicon has it, the word itself; learned transitions let neighbours help each other in
code-switched text. Forward-backward gives each word's marginals; a document takes the
language with the largest share of its letters.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from viewloom.llm.crf import fit, sequence_marginals
from viewloom.operators.skew import lookup
from viewloom.operators.staging import stored

WORD = re.compile(r"[^\W\d_]+")
ORDERS = (1, 2, 3, 4)
HASHED = 1 << 17
#: The classifier is fitted on so many documents of each language, and words of each, at most.
SAMPLE, SAMPLE_WORDS = 100, 1000
#: Training sequences join runs of so many words from documents of any language.
RUN = (4, 40)
ROUNDS, RATE, PENALTY = 30, 0.1, 1e-6
BLOCK_CHARS = 4 << 20
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return WORD.findall(text.lower()) if text else []


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, word after word, and how many each word has."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    hashes, owners = [], []
    for n in ORDERS:
        starts = np.arange(max(0, len(codes) - n + 1))
        starts = starts[owner[starts] == owner[starts + n - 1]]
        h = np.full(len(starts), n, np.uint64)
        for i in range(n):
            h = (h * np.uint64(1_000_003)) ^ codes[starts + i]
        h ^= h >> np.uint64(17)
        hashes.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47))
        owners.append(owner[starts])
    owners, hashes = np.concatenate(owners), np.concatenate(hashes).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return hashes[order], np.bincount(owners, minlength=len(words))


def _features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-grams, their number per word, and the lexicon's number per word (-1: not in it)."""
    hashes, sizes = ngrams(words)
    return hashes, sizes, np.array([lexicon.get(w, -1) for w in words], np.int64)


def _scores(weights: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(hashes) + 1, weights.shape[1]))
    np.cumsum(weights[hashes], axis=0, out=sums[1:])
    ends = np.cumsum(sizes)
    out = (sums[ends] - sums[ends - sizes]) / np.sqrt(np.maximum(sizes, 1))[:, None]
    out[known >= 0] += weights[HASHED + known[known >= 0]]
    return out


@dataclass
class LanguageModel:
    """Without any training document there are no languages, and every text is unknown."""

    languages: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def word_marginals(self, texts: list[list[str]]) -> np.ndarray:
        """Marginals of the languages for each word of each text, behind each other."""
        index: dict[str, int] = {}
        flat = np.array([index.setdefault(w, len(index)) for text in texts for w in text], np.int64)
        if not len(flat):
            return np.zeros((0, len(self.languages)))
        scores = _scores(self.weights, *_features(list(index), self.lexicon))[flat]
        lengths = np.array([len(t) for t in texts], np.int64)
        return sequence_marginals(scores, self.trans, self.start, lengths[lengths > 0])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its share of the letters; a text without a letter is unknown with share 0."""
        out: list[tuple[str, float]] = []
        block: list[list[str]] = []
        held = 0

        def flush() -> None:
            marginal = self.word_marginals(block)
            letters = np.array([len(w) for words in block for w in words], float)
            at = 0
            for words in block:
                if words:
                    shares = letters[at : at + len(words)] @ marginal[at : at + len(words)]
                    at += len(words)
                    best = int(np.argmax(shares))
                    out.append((self.languages[best], min(1.0, float(shares[best] / shares.sum()))))
                else:
                    out.append((UNKNOWN, 0.0))
            block.clear()

        for text in texts:
            has_letter = bool(self.languages) and bool(text) and any(map(str.isalpha, text))
            block.append(words_of(text) if has_letter else [])
            held += len(text or "")
            if held > BLOCK_CHARS:
                flush()
                held = 0
        if block:
            flush()
        return out


def sample(docs: DataFrame, most: int = SAMPLE) -> DataFrame:
    """At most `most` documents of each language, by a hash of the id: id, text, lang."""
    pool = docs.where("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("id", "lang")
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    few = pool.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= most).select("id", "lang").distinct()
    # a few rows per language: measured, and broadcast to the texts
    return lookup(docs.select("id", "text"), stored(few.withColumnRenamed("id", "_id")), {"id": "_id"}, "inner")


def _sequences(texts: list[list[str]], gold: list[int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Code-switched training sequences: runs of all texts in random order, joined by eights."""
    random = np.random.default_rng(7)
    runs = []
    for words, state in zip(texts, gold):
        at = 0
        while at < len(words):
            size = int(random.integers(*RUN))
            runs.append((words[at : at + size], state))
            at += size
    runs = [runs[i] for i in random.permutation(len(runs))]
    words = [w for run, _ in runs for w in run]
    states = np.concatenate([np.full(len(run), state) for run, state in runs] or [np.zeros(0, np.int64)])
    sizes = np.array([len(run) for run, _ in runs], np.int64)
    return words, states, np.add.reduceat(sizes, np.arange(0, len(sizes), 8)) if len(sizes) else sizes


def train(docs: DataFrame, most: int = SAMPLE) -> LanguageModel:
    """Fit on a bounded sample of `docs` (id, text, lang); the sampled words come to the driver.

    Rows with a null id, text or language are not learned from; empty texts add no words, and of a very
    long text the first SAMPLE_WORDS words are taken. Without any row every text is `und`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [" ".join(words_of(text)[:SAMPLE_WORDS]) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(words, pa.string())], ["lang", "words"])

    rows = sample(docs, most).select("id", "text", "lang").mapInArrow(run, "lang string, words string").collect()
    rows = sorted((r["lang"], r["words"]) for r in rows)
    languages = sorted({lang for lang, _ in rows})
    texts, gold = [words.split() for _, words in rows], [languages.index(lang) for lang, _ in rows]
    counts = Counter(w for words in texts for w in words)
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in counts.items() if n > 1))}
    words, states, lengths = _sequences(texts, gold)
    index: dict[str, int] = {}
    flat = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    shape = (HASHED + len(lexicon), len(languages))
    if not len(flat):
        return LanguageModel([], np.zeros((HASHED, 0)), np.zeros((0, 0)), np.zeros(0))
    hashes, sizes, known = _features(list(index), lexicon)
    owner, scale = np.repeat(np.arange(len(index)), sizes), 1 / np.sqrt(np.maximum(sizes, 1))

    def backprop(wrong: np.ndarray) -> np.ndarray:
        out = np.zeros(shape)
        for s in range(shape[1]):
            by_word = np.bincount(flat, weights=wrong[:, s], minlength=len(index))
            out[:HASHED, s] = np.bincount(hashes, weights=(by_word * scale)[owner], minlength=HASHED)
            out[HASHED:, s] = np.bincount(known[known >= 0], weights=by_word[known >= 0], minlength=len(lexicon))
        return out

    found = fit(lambda w: _scores(w, hashes, sizes, known)[flat], backprop, shape, states, lengths, ROUNDS, RATE, PENALTY)
    weights, trans, start = found
    return LanguageModel(languages, weights.astype(np.float32), trans, start, lexicon)


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, `lang_pred` and `score`.

    A text that is null or has no letter is `und` with score 0. Repeated rows stay repeated;
    other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.predict(batch.column(1).to_pylist())
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "lang_pred", "score"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, lang_pred string, score double")
    return found.select(F.col("id").alias(id_column), "lang_pred", "score")
