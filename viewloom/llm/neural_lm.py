"""Scoring by a log-bilinear language model, trained with noise-contrastive estimation.

1. All words of the training texts are counted (a row per task and word in the shuffle).
2. Words form classes, whose number grows with the square root of the distinct words: the most
   frequent words are classes by themselves, all others are dealt over classes by their endings.
   Inside its class a word has its smoothed share of the counts. So text of any words has a probability.
3. Classes lie in sections. A context, the vectors of the two words' classes before, first predicts
   the section and then the class in it: two small matrix products normalise a probability.
4. Every training partition trains a copy of the model in numpy, on the counts of its own
   (context, class) triples; the copies are averaged by Spark, weighted by their tokens.
5. Scoring goes through distinct contexts of a block of texts. Counts of the words that are no class of their own
   come through the shuffle of distinct words per block (word_blocks).
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from viewloom.llm.word_blocks import (
    BLOCK_BYTES, Block, block_number, buckets_for, meet, numbered_words, schema_of, squeeze, texts_of, unsqueeze,
    unsqueeze_words, words_by_bucket, words_of,
)
from viewloom.operators.staging import stored

END = b""  # counted as a word; no word is empty
ALPHA = 0.1
WIDTH, CONTEXT = 16, 2
SINGLES, GROUPS = 2.0, 0.5  # classes of one word, and of many, per square root of the distinct words
LEAST_SINGLES = 256  # a small vocabulary has so many classes of one word all the same
ENDING = 2  # bytes by which words are dealt over classes
LONGEST = 64  # a longer word is known by its digest, so the model's size does not follow it
NOISE, NOISE_WEIGHT, BATCH, RATE, ROUNDS, SEED = 32, 10.0, 2048, 0.1, 1, 11
LEAST_STEPS = 200  # a block of few triples is gone through again
SHARES = 200_000  # a triple's count is cut into parts of at most this share of all tokens
TRIPLES_BYTES = 16 << 20
WORD_BYTES = 8  # of text a word, about


@dataclass
class Counts:
    """What all words of the training texts come to. `words` is the stored table (word, c).

    `frequent` are the words that are classes, by `known_as`; `grouped` holds per class of many words their
    tokens and how many distinct words they are.
    """

    words: DataFrame
    tokens: int
    distinct: int
    frequent: list[tuple[bytes, int]]
    grouped: np.ndarray

    @property
    def base_norm(self) -> float:
        return self.tokens + ALPHA * (self.distinct + 1)

    def group_norms(self) -> np.ndarray:
        """Each class of many words has room for one word more that was never seen."""
        return self.grouped[:, 0] + ALPHA * (self.grouped[:, 1] + 1)


def known_as(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b" " + hashlib.md5(word).digest()


def count(docs: DataFrame, classes: int | None = None) -> Counts:
    """Count all words of the column `text`, an end after each text included.

    `classes` overrides how many words are classes of their own. A null or empty text is one end; no texts give
    no words, and one class for all that may come. Repeated rows count as often as they stand there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0

        def batch_of(found: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
            words, c = zip(*found)
            met = pa.concat_arrays(words).dictionary_encode()
            sums = np.bincount(met.indices.to_numpy(), np.concatenate(c), len(met.dictionary)).astype(np.int64)
            return pa.RecordBatch.from_arrays([met.dictionary.cast(pa.binary()), pa.array(sums)], ["word", "c"])

        for numbers, words in numbered_words(raw for batch in batches for raw in batch.column(0).to_pylist()):
            found.append((words, np.bincount(numbers, minlength=len(words))))
            held += words.nbytes
            if held > 2 * BLOCK_BYTES:
                yield batch_of(found)
                found, held = [], 0
        if found:
            yield batch_of(found)

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "word binary, c long")
    words = stored(rows.groupBy("word").agg(F.sum("c").alias("c")))
    total = words.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    tokens, distinct = int(total[1]), int(total[0])
    singles = max(LEAST_SINGLES, math.ceil(SINGLES * math.sqrt(distinct))) if classes is None else classes
    groups = max(1, math.ceil(GROUPS * math.sqrt(distinct)))
    ending = F.when(F.length("word") > ENDING, F.substring("word", -ENDING, ENDING)).otherwise(F.col("word"))
    words_in = words.withColumn("g", F.crc32(ending) % groups)
    name = F.when(F.length("word") <= LONGEST, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.md5("word"))))
    most = words_in.orderBy(F.desc("c"), "word").limit(singles).select(name.alias("name"), "c", "g").collect()
    grouped = np.zeros((groups, 2))
    for r in words_in.groupBy("g").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():  # a row per class
        grouped[r["g"]] = r["c"], r["n"]
    for r in most:
        grouped[r["g"]] -= r["c"], 1
    return Counts(words, tokens, distinct, [(bytes(r["name"]), int(r["c"])) for r in most], grouped)


@dataclass
class Model:
    """Classes 0 to len(index) - 1 are words, those behind them groups of words; the last row of `context`
    stands for a place before the text. `cuts` are the classes at which sections begin, and the end."""

    index: dict[bytes, int]
    groups: int
    cuts: np.ndarray
    context: np.ndarray  # (classes + 1, width)
    top: np.ndarray  # (sections, width)
    top_bias: np.ndarray
    output: np.ndarray  # (classes, width)
    bias: np.ndarray
    position: np.ndarray  # (CONTEXT, width): how each place of the context is weighted

    @property
    def section(self) -> np.ndarray:
        """Of each class the section."""
        return np.repeat(np.arange(len(self.cuts) - 1), np.diff(self.cuts))

    def classes(self, words: list[bytes] | pa.Array) -> np.ndarray:
        if isinstance(words, list):
            words = pa.array(words, pa.large_binary())
        names = pa.array(list(self.index), words.type)
        found = pa.compute.index_in(words, value_set=names).fill_null(-1).to_numpy().astype(np.int32)
        for at in np.flatnonzero(pa.compute.binary_length(words).to_numpy() > LONGEST).tolist():
            found[at] = self.index.get(known_as(words[at].as_py()), -1)
        endings = pa.compute.binary_slice(words, -ENDING).dictionary_encode()
        group = np.array([zlib.crc32(e) % self.groups for e in endings.dictionary.to_pylist()], np.int32)
        return np.where(found >= 0, found, len(self.index) + group[endings.indices.to_numpy()])

    @property
    def parts(self) -> tuple[np.ndarray, ...]:
        return self.context, self.top, self.top_bias, self.output, self.bias, self.position

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts])

    def with_flat(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in self.parts:
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(self.index, self.groups, self.cuts, *parts)

    def predicted(self, contexts: np.ndarray) -> np.ndarray:
        """The vector a context predicts: its words' vectors, weighted by place."""
        return sum(self.context.take(contexts[:, i], axis=0) * self.position[i] for i in range(CONTEXT))

    def log10(self, contexts: np.ndarray, targets: np.ndarray, step: int = 1 << 11) -> np.ndarray:
        """Normalised log10 probability of each target after its context: that of its section, then of the class in it.

        `step` rows at a time, few enough to stay in a processor's cache."""
        rows, sections = len(self.context), len(self.cuts) - 1
        triples = (contexts[:, 0] * rows + contexts[:, 1]) * rows + targets
        distinct, which = np.unique(triples, return_inverse=True)  # (context, class), each once
        pairs, aims = np.divmod(distinct, rows)
        first = _firsts(pairs)  # they ascend: each context once
        context = np.cumsum(first) - 1
        alone = pairs[first]
        vectors, tops = np.empty((len(alone), WIDTH), np.float32), np.empty(len(alone), np.float32)
        for at in range(0, len(alone), step):
            some = slice(at, at + step)
            vectors[some] = self.predicted(np.stack(np.divmod(alone[some], rows), axis=1))
            tops[some] = _log_sum(vectors[some] @ self.top.T + self.top_bias)
        section = self.section[aims]
        begins = np.flatnonzero(_firsts(context * sections + section))  # classes of a section follow each other too
        of_context, of_section = context[begins], section[begins]
        order = np.argsort(_short(of_section, sections), kind="stable")
        ends = np.searchsorted(of_section[order], np.arange(sections), side="right")
        norms = np.empty(len(begins))  # of the class's score, to be taken off, with the section's own
        begin = 0
        for one, end in enumerate(ends.tolist()):
            lo, hi = self.cuts[one], self.cuts[one + 1]
            for at in range(begin, end, step):
                some = order[at : min(at + step, end)]
                seen = vectors.take(of_context.take(some), axis=0)
                own = seen @ self.top[one] + self.top_bias[one]
                norms[some] = tops.take(of_context.take(some)) - own + _log_sum(seen @ self.output[lo:hi].T + self.bias[lo:hi])
            begin = end
        norms = np.repeat(norms, np.diff(np.append(begins, len(distinct))))
        out = np.empty(len(distinct))
        for at in range(0, len(distinct), step):
            part = slice(at, at + step)
            score = np.einsum("ij,ij->i", vectors.take(context[part], axis=0), self.output.take(aims[part], axis=0)) + self.bias.take(aims[part])
            out[part] = (score - norms[part]) / np.log(10)
        return out[which]


def _short(numbers: np.ndarray, below: int) -> np.ndarray:
    """Numbers of few bits, which sort faster."""
    return numbers.astype(np.uint16) if below <= 1 << 16 else numbers


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Whether each of ascending numbers differs from the one before."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _log_sum(scores: np.ndarray) -> np.ndarray:
    """Per row the logarithm of the sum of exponentials; `scores` are overwritten."""
    most = scores.max(axis=1)
    scores -= most[:, None]
    return most + np.log(np.exp(scores, out=scores).sum(axis=1))


def contexts_of(classes: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """The CONTEXT classes before each item; `starts` are the first items of the texts."""
    out = np.full((len(classes), CONTEXT), before, np.int64)
    for back in range(1, CONTEXT + 1):
        column = out[:, CONTEXT - back]
        column[back:] = classes[:-back]
        for place in range(back):  # behind a shorter text, these are among the first of the next one
            column[starts[starts < len(classes) - place] + place] = before
    return out


def initial(counts: Counts) -> Model:
    """Vectors near zero and biases at the classes' frequencies: at first a unigram model."""
    random = np.random.default_rng(SEED)
    share = np.array([*[c for _, c in counts.frequent], *counts.grouped[:, 0]]) + ALPHA
    n = len(share)
    cuts = np.unique(np.linspace(0, n, math.ceil(math.sqrt(n)) + 1).astype(np.int64))
    small = lambda rows: random.normal(0, 0.1, (rows, WIDTH)).astype(np.float32)
    logs = lambda x: np.log(x / share.sum()).astype(np.float32)
    index = {w: i for i, (w, _) in enumerate(counts.frequent)}
    tops = logs(np.add.reduceat(share, cuts[:-1]))
    return Model(index, len(counts.grouped), cuts, small(n + 1), small(len(cuts) - 1), tops, small(n), logs(share), np.ones((CONTEXT, WIDTH), np.float32))


class Trainer:
    """Noise-contrastive estimation by Adagrad on weighted (context, class) triples, of sections and of the classes in each."""

    def __init__(self, model: Model, seed: int):
        self.m = model.with_flat(model.flat())
        self.random = np.random.default_rng(seed)
        self.squares = [np.full(x.shape, 1e-8, np.float32) for x in self.m.parts]
        self.section = self.m.section
        shares = np.exp(model.bias.astype(np.float64))
        #: per task, the sections (-1) and each section's classes: the first row, log share and cumulated share of what may be noise
        self.noise = {-1: self._noise(0, np.add.reduceat(shares, model.cuts[:-1]))}
        for one, (lo, hi) in enumerate(zip(model.cuts[:-1], model.cuts[1:])):
            self.noise[one] = self._noise(int(lo), shares[lo:hi])

    @staticmethod
    def _noise(first: int, shares: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        shares = shares / shares.sum()
        return first, np.log(shares).astype(np.float32), np.cumsum(shares)

    def _step(self, k: int, together, grad: np.ndarray) -> None:
        """An Adagrad step of part `k`: of all of it, or of the rows that `_together` sorted."""
        x = self.m.parts[k]
        if together is None:
            self.squares[k] += grad * grad
            x += RATE * grad / np.sqrt(self.squares[k])
            return
        order, firsts, distinct = together
        total = np.add.reduceat(grad.take(order, axis=0), firsts, axis=0)
        square = self.squares[k].take(distinct, axis=0)
        square += total * total
        self.squares[k][distinct] = square
        total *= RATE
        total /= np.sqrt(square, out=square)
        total += x.take(distinct, axis=0)
        x[distinct] = total

    @staticmethod
    def _together(rows: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in ascending order, where each distinct one begins there, and the distinct ones."""
        order = np.argsort(_short(rows, below), kind="stable")
        ordered = rows.take(order)
        firsts = np.flatnonzero(_firsts(ordered))
        return order, firsts, ordered[firsts]

    def train(self, contexts: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> None:
        """Go through ascending triples with their counts: all sections together, and the classes of each section."""
        section = self.section[targets]
        few = _short(section, len(self.noise))
        rows = len(self.m.context)
        # what comes to one section after the same context is one triple there
        keys = (contexts[:, 0] * rows + contexts[:, 1]) * len(self.noise) + section
        first = np.flatnonzero(np.diff(keys, prepend=-1))  # triples ascend, and so do these
        deals = [
            self._deal(contexts[first], section[first], np.add.reduceat(counts, first)),
            self._deal(contexts, targets, counts),
        ]
        for _ in range(max(1, LEAST_STEPS * BATCH // max(BATCH, len(deals[1][2])))):
            batches = []
            for sections, (_, aims, order, _) in zip((True, False), deals):
                order = self.random.permutation(order)
                if sections:
                    batches += [(-1, order[at : at + BATCH]) for at in range(0, len(order), BATCH)]
                    continue
                order = order[np.argsort(few[order], kind="stable")]
                ends = np.cumsum(np.bincount(few[order], minlength=len(self.noise) - 1))
                for one, (begin, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                    batches += [(one, order[at : min(at + BATCH, end)]) for at in range(begin, end, BATCH)]
            for k in self.random.permutation(len(batches)).tolist():
                task, some = batches[k]
                seen, aims, _, weights = deals[task >= 0]
                if len(self.noise[task][1]) > 1:
                    self._batch(task, seen.take(some, axis=1), aims.take(some), weights.take(some))

    @staticmethod
    def _deal(contexts: np.ndarray, targets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Triples (contexts by place), the rows to go through, and each triple's weight in one; a frequent triple is dealt over many batches."""
        share = max(1, -(-int(counts.sum()) // SHARES))
        parts = -(-counts // share)
        rows = np.repeat(np.arange(len(targets)), parts)
        weights = (counts / parts).astype(np.float32)
        below = int(max(contexts.max(), targets.max())) + 1
        return _short(contexts.T.copy(), below), _short(targets, below), rows, weights / weights[rows].mean()

    def _batch(self, task: int, contexts: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> None:
        m, (first, log_noise, cumulated) = self.m, self.noise[task]
        output, bias = (m.output, m.bias) if task >= 0 else (m.top, m.top_bias)
        draws = np.searchsorted(cumulated, self.random.random(NOISE) * cumulated[-1])
        noise = np.minimum(draws, len(log_noise) - 1)
        log_weight = math.log(NOISE_WEIGHT)
        log_true, log_false = log_noise[targets - first] + log_weight, log_noise[noise] + log_weight
        noise = noise + first
        seen = [m.context.take(place, axis=0) for place in contexts]
        vectors = sum(x * p for x, p in zip(seen, m.position))
        aims, others = output.take(targets, axis=0), output.take(noise, axis=0)
        # a section's biases are those of its classes among all; among themselves they differ by a constant
        level = 0.0 if task < 0 else m.top_bias[task]
        true = np.einsum("ij,ij->i", vectors, aims) + (bias[targets] - level - log_true)
        false = vectors @ others.T
        false += bias[noise] - level - log_false
        scale = weights / BATCH
        up = (scale / (1 + np.exp(np.clip(true, -30, 30)))).astype(np.float32)
        np.clip(np.negative(false, out=false), -30, 30, out=false)
        np.exp(false, out=false)
        false += 1
        down = np.divide((scale * (NOISE_WEIGHT / NOISE))[:, None], false, out=false)
        by_vector = up[:, None] * aims - down @ others
        places = [np.einsum("ij,ij->j", by_vector, x) for x in seen]
        by_context = np.concatenate([by_vector * m.position[i] for i in range(CONTEXT)])
        rows = np.concatenate([targets, noise.astype(targets.dtype)])
        by_row = np.concatenate([up[:, None] * vectors, -(down.T @ vectors)])
        by_bias = np.concatenate([up, -down.sum(axis=0)])
        self._step(0, self._together(contexts.ravel(), len(m.context)), by_context)
        together = self._together(rows, len(output))
        self._step(3 if task >= 0 else 1, together, by_row)
        self._step(4 if task >= 0 else 2, together, by_bias)
        self._step(5, None, np.stack(places))


def _classes_of(texts: list[bytes | None], model: Model, block: Block | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all items of texts, an end after each, and where each text begins. `block` gets those that share a class."""
    codes, ends = [], []
    for numbers, words in numbered_words(texts):
        kind = model.classes(words)
        codes.append(kind[numbers])
        ends.append(numbers == pa.compute.index(words, END).as_py())
        if block is not None:
            shared = kind >= len(model.index)
            place = np.cumsum(shared) - 1
            block.add_numbered(words_of(words.filter(pa.array(shared))), place[numbers[shared[numbers]]])
    return np.concatenate(codes).astype(np.int64), np.flatnonzero(np.concatenate([[True], *ends])[:-1])


def train(docs: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Train on all rows of the column `text`, in `rounds` rounds of averaged copies.

    What comes to the driver is the averaged model, some numbers per class. Texts are read
    whole; a task trains on one block of triple counts after the other. The more tasks, the less each copy
    sees before they are averaged. Null and empty texts are one end; no text at all leaves the model as it began.
    """
    model = initial(counts)
    if not counts.frequent:
        return model
    for number in range(rounds):
        now = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = len(now.context)
            trainer = Trainer(now, SEED + 1000 * number + TaskContext.get().partitionId())
            texts, size, tokens = [], 0, 0

            def learn() -> int:
                flat, starts = _classes_of(texts, now)
                context = contexts_of(flat, starts, rows - 1)
                triples = (context[:, 0] * rows + context[:, 1]) * rows + flat
                distinct, n = np.unique(triples, return_counts=True)
                pairs = distinct // rows
                trainer.train(np.stack([pairs // rows, pairs % rows], axis=1), distinct % rows, n)
                return len(flat)

            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    texts.append(raw)
                    size += len(raw or b"")
                    if size > TRIPLES_BYTES:
                        tokens += learn()
                        texts, size = [], 0
            if texts:
                tokens += learn()
            if tokens:
                flat = trainer.m.flat().astype(np.float64)
                columns = [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat), pa.array(np.full(len(flat), float(tokens)))]
                yield pa.RecordBatch.from_arrays(columns, ["at", "value", "n"])

        copies = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "at int, value double, n double")
        mean = copies.groupBy("at").agg((F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("value")).collect()
        flat = now.flat().astype(np.float64)
        for r in mean:
            flat[r["at"]] = r["value"]
        model = now.with_flat(flat)
    return model


def _score_blocks(docs: DataFrame, id_column: str, text_column: str, model: Model, counts: Counts, buckets: int) -> DataFrame:
    """Blocks whose words are those that share a class; `more` holds per text what the model says of the classes."""
    singles, norms = len(counts.frequent), np.log10(counts.group_norms())
    base = np.log10((np.array([*[c for _, c in counts.frequent], *np.zeros(len(norms))]) + ALPHA) / counts.base_norm)
    inside = np.concatenate([np.zeros(singles), norms])  # what a word's smoothed count is divided by in its class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, held, id_type = TaskContext.get().partitionId(), 0, 0, None
        keys, texts = [], []

        def flush() -> Iterator[pa.RecordBatch]:
            block = Block()
            flat, first = _classes_of(texts, model, block)
            said = model.log10(contexts_of(flat, first, len(model.context) - 1), flat)
            known = flat < singles
            columns = [said - inside[flat], np.where(known, base[flat], 0.0), known.astype(float), np.ones(len(flat))]
            more = np.stack([np.add.reduceat(c, first) for c in columns])
            block.ids, block.sizes = keys, np.add.reduceat(~known, first, dtype=np.int64)
            yield from block.batches(block_number(partition, number), buckets, id_type, more.tobytes())

        for batch in batches:
            id_type = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = len(raw or b"")
                if held and held + size > BLOCK_BYTES:
                    yield from flush()
                    keys, texts, held, number = [], [], 0, number + 1
                keys.append(key)
                texts.append(raw)
                held += size + 1
        if held:
            yield from flush()

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("text"))
    return rows.mapInArrow(run, schema_of(rows.schema["id"]))


def _look_up(key, words: pa.Table, counted: pa.Table) -> pa.Table:
    """The counts of a bucket's words, for each block that asks."""
    known = dict(zip(counted.column("word").to_pylist(), counted.column("c").to_pylist()))
    out = []
    for row in words.to_pylist():
        found = np.array([known.get(w, 0) for w in unsqueeze_words(row["sizes"], row["words"])], np.uint64)
        out.append((row["block"], row["numbers"], squeeze(found)))
    kinds = [pa.int64(), pa.binary(), pa.binary()]
    columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)]
    return pa.Table.from_arrays(columns, names=["block", "places", "counts"])


def _total(base_norm: float):
    def run(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
        row, parts = texts_of(texts), answers.to_pylist()
        places = np.concatenate([unsqueeze(p["places"], np.uint32) for p in parts] or [np.zeros(0, np.uint32)])
        counts = np.concatenate([unsqueeze(p["counts"], np.uint64) for p in parts] or [np.zeros(0, np.uint64)])
        at = np.zeros(len(places))
        at[places] = counts
        numbers, sizes = unsqueeze(row["numbers"], np.uint32), unsqueeze(row["sizes"], np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        logs = np.bincount(owner, weights=np.log10(at + ALPHA)[numbers], minlength=len(sizes))
        seen = np.bincount(owner, weights=(at > 0)[numbers], minlength=len(sizes))
        said, base, known, tokens = np.frombuffer(row["more"], np.float64).reshape(4, -1)
        columns = [
            pa.array(tokens.astype(np.int64)), pa.array((known + seen).astype(np.int64)),
            pa.array(base + logs - sizes * np.log10(base_norm)), pa.array(said + logs),
        ]
        ids = texts.column("ids").combine_chunks().filter(pa.compute.less(texts.column("bucket"), 0).combine_chunks())
        return pa.table([ids.flatten(), *columns], names=["id", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(
    docs: DataFrame,
    counts: Counts,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """Per row: id, n_tokens, n_known, base_score and score, in log10.

    Words are runs without ASCII white space, A-Z in lower case, and one end after each text;
    a null or empty text is one end. Repeated rows stay repeated; other columns are not looked
    at. Without any training text the base gives every token probability 1.
    """
    buckets = buckets or buckets_for(docs.sparkSession, WORD_BYTES * counts.tokens)
    dealt = meet(_score_blocks(docs, id_column, text_column, model, counts, buckets))
    asked = words_by_bucket(dealt)
    crc = F.crc32("word") % buckets
    counted = counts.words.select("word", "c", crc.cast("int").alias("bucket"))
    answers = asked.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(
        _look_up, "block long, places binary, counts binary"
    )
    kind = docs.schema[id_column].dataType.simpleString()
    out = f"id {kind}, n_tokens long, n_known long, base_score double, score double"
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_total(counts.base_norm), out)
    return found.select(F.col("id").alias(id_column), "n_tokens", "n_known", "base_score", "score")
