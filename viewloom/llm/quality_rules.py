"""Quality rules as a ledger of bitmasks.

Every rule is evaluated once per document: the ledger holds the measurements and one long
with a bit per failed rule. Policies are masks over that long, each with a version; verdicts,
and what each rule adds to a policy (ablation), need no second look at the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from viewloom.llm.common import raw_words

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper"]
BLOCK_BYTES = 8 << 20


def _share(part: str, whole: str, most: float) -> Column:
    return F.col(part) > F.lit(most) * F.col(whole)


def rules() -> dict[str, Column]:
    """Name and condition of failure, in the order of their bits. New rules go to the end."""
    return {
        "few_words": F.col("n_words") < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * F.col("n_words"),
        "short_words": F.col("word_chars") < 2 * F.col("n_words"),
        "long_words": F.col("word_chars") > 20 * F.col("n_words"),
        "many_symbols": _share("n_symbols", "n_words", 0.5),
        "repeated_lines": (F.col("n_lines") > 3) & _share("n_dup_lines", "n_lines", 0.5),
        "few_letters": F.col("n_letters") < 0.5 * F.col("word_chars"),
        "mostly_upper": (F.col("n_letters") > 0) & _share("n_upper", "n_letters", 0.7),
    }


#: Version and the rules whose failure rejects a document. Versions are never changed, only added.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "short_words", "long_words", "many_symbols"],
    "v2": ["few_words", "repeated_words", "short_words", "long_words", "many_symbols", "few_letters", "mostly_upper"],
    "strict": ["few_words", "repeated_words", "short_words", "long_words", "many_symbols", "few_letters", "mostly_upper",
               "repeated_lines"],
}
CURRENT = "v2"


def mask_of(names: Sequence[str]) -> int:
    bits = {name: 1 << at for at, name in enumerate(rules())}
    return sum(bits[name] for name in names)


def repeated_words(codes: np.ndarray, text: np.ndarray, n_texts: int, size: int = WINDOW) -> np.ndarray:
    """Per text, how many words stand in windows of `size` words that occur twice or more in it.

    `codes` number the words, `text` says which text each belongs to (ascending). Windows are
    numbered exactly, by doubling: a window of 2 k words is a pair of numbered windows of k.
    """
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(n_texts, np.int64)
    windows, length = codes.astype(np.int64), 1
    while length < size:
        step = min(length, size - length)
        left, right = windows[: len(windows) - step], windows[step:]
        windows = pd.factorize(left * (int(windows.max()) + 1) + right)[0].astype(np.int64)
        length += step
    inside = text[:n] == text[size - 1 :]
    numbers = pd.factorize(np.where(inside, windows[:n] * n_texts + text[:n], -1))[0]
    again = inside & (np.bincount(numbers)[numbers] > 1)
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + size, -1)
    return np.bincount(text[np.cumsum(edge[:-1]) > 0], minlength=n_texts)


def _measure(texts: list[str | None]) -> list[list[int]]:
    """MEASURES of a block of texts."""
    out, owner, index, codes = [], [], {}, [np.zeros(0, np.int32)]
    for at, text in enumerate(texts):
        text = text or ""
        raw, n, chars = text.encode(), 0, 0
        for part in raw_words(raw):
            n += len(part)
            chars += len(b"".join(part).decode())
            codes.append(np.array([index.setdefault(w, len(index)) for w in part], np.int32))
        owner.append(n)
        n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        seen, lines, repeated = set(), 0, 0
        for line in raw.split(b"\n"):
            if line.split(None, 1):
                lines += 1
                repeated += line in seen
                seen.add(line)
        letters = sum(map(str.isalpha, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _LETTERS))
        upper = sum(map(str.isupper, text)) if not text.isascii() else len(raw) - len(raw.translate(None, _UPPER))
        out.append([n, chars, n_symbols, repeated, 0, lines, letters, upper])
    text = np.repeat(np.arange(len(texts)), owner)
    for row, n in zip(out, repeated_words(np.concatenate(codes), text, len(texts))):
        row[4] = int(n)
    return out


_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _blocks(texts: list[str | None], size: int) -> Iterator[list[str | None]]:
    """Consecutive texts of about `size` characters; a longer text is a block by itself."""
    block, held = [], 0
    for text in texts:
        if block and held + len(text or "") > size:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text or "")
    yield block


def ledger(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, the measurements and `failed`, a long with a bit per failed rule.

    Words are runs without ASCII white space. A null text has no words and measures 0. Repeated
    rows stay repeated; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for block in _blocks(batch.column(1).to_pylist(), BLOCK_BYTES) for row in _measure(block)]
            columns = [pa.array([row[k] for row in rows], pa.int64()) for k in range(len(MEASURES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *MEASURES])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    measured = rows.mapInArrow(run, ", ".join([f"id {kind}", *[f"{m} long" for m in MEASURES]]))
    bits = [F.when(c, F.lit(1 << at)).otherwise(0).cast("long") for at, c in enumerate(rules().values())]
    failed = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return measured.select(F.col("id").alias(id_column), *MEASURES, failed.alias("failed"))


def verdicts(ledger: DataFrame, version: str = CURRENT, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """The ledger with `base_failed` and `kept` under one version of the policy."""
    fails = lambda names: F.col("failed").bitwiseAND(F.lit(mask_of(names))) != 0
    base = fails(policies["base"])
    return ledger.withColumns({"base_failed": base, "kept": ~base & ~fails(policies[version])})


def ablated(ledger: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """The ledger with, per version of the policy, `kept_<version>` and `only_<version>`: the one rule that alone
    rejects the row, null if none or several do."""
    names = list(rules())
    columns = {}
    for version, some in policies.items():
        hit = F.col("failed").bitwiseAND(F.lit(mask_of(some)))
        columns[f"kept_{version}"] = hit == 0
        only = F.get(F.array(*[F.lit(n) for n in names]), F.round(F.log2(hit)).cast("int"))
        columns[f"only_{version}"] = F.when(F.bit_count(hit) == 1, only)
    return ledger.withColumns(columns)


def ablations(ledger: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES) -> DataFrame:
    """Per version and rule: documents that fail the rule, and those only this rule rejects.

    The ledger is first counted per mask, a table of at most 2 ** rules rows; all versions and
    rules are read off those counts. An empty ledger gives no rows.
    """
    masks = ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    names = list(rules())
    asked = [F.struct(F.lit(v).alias("version"), F.lit(r).alias("rule"), F.lit(mask_of(p)).alias("policy"), F.lit(1 << names.index(r)).alias("bit"))
             for v, p in policies.items() for r in p]
    rows = masks.select("failed", "n", F.explode(F.array(*asked)).alias("ask")).select("failed", "n", "ask.*")
    hit = F.col("failed").bitwiseAND(F.col("policy"))
    return rows.groupBy("version", "rule").agg(
        F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )
