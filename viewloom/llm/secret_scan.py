"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Text that a tokenizer has seen alike takes few tokens for many characters; a random string
takes nearly one for every one or two. So a run of key-like characters with a low number of
characters per token is reported, unless it is a known digest or an identifier.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from viewloom.llm.common import position, slices
from viewloom.llm.vocabulary import Vocabulary

KINDS = ["assign", "access", "hex", "random"]
# The base patterns and their least lengths. A run of one class of characters
# is matched whole or not at all, so for access and hex the length is part of the pattern.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGNED = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Runs that may be keys, at least this long, with at most so many characters a token.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 2.2
#: Of fewer different characters it is no key but a rule or filler, such as one letter repeated.
DISTINCT = 5
#: What is left of such a run beside a base span is tested from this length on.
REST = 8
#: Not secrets: hex digests of the usual lengths, UUIDs, numbers and dates, words joined by marks.
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[0-9+/_=-]+")
WORDS = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+(?![0-9])|[+/_=-]++)*+")
#: The words of an identifier are shorter; a longer one, or a long code, is judged by its tokens.
LONG_WORD = re.compile(r"[A-Z]?[a-z]{12,}|[A-Z]{12,}|[A-Z0-9]{18,}")


def tokens_in(vocabulary: Vocabulary) -> Callable[[str], int]:
    """Counts the tokens of a string; the tokenizer is built at the first call."""
    built = []

    def count(run: str) -> int:
        if not built:
            built.append(vocabulary.encoding())
        return len(built[0].encode_ordinary(run))

    return count


def _case_changes(run: str) -> int:
    """How often kinds of character change between neighbours."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "" for c in run]
    kinds = [k for k in kinds if k]
    return sum(a != b for a, b in zip(kinds, kinds[1:]))


def looks_random(run: str, tokens: Callable[[str], int], ratio: float = RATIO) -> bool:
    """Few characters per token, and neither digest nor identifier.

    An identifier is made of words of ordinary length and short numbers: its kinds of character
    change seldom, less than once in six characters. A long run of letters is none, whatever its case.
    """
    if DIGEST.fullmatch(run) or UUID.fullmatch(run) or NUMBER.fullmatch(run):
        return False
    if len(set(run)) < DISTINCT:
        return False
    if WORDS.fullmatch(run) and not LONG_WORD.search(run) and _case_changes(run) * 6 < len(run):
        return False
    return len(run) <= ratio * tokens(run)


def _outside(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of [start, end) that no base span covers; `base` are those that may touch it, by start."""
    for begin, _, stop in base:
        if begin > start:
            yield start, min(begin, end)
        start = max(start, stop)
        if start >= end:
            return
    if start < end:
        yield start, end


def spans_of(text: str, tokens: Callable[[str], int], ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all secrets, by start and kind.

    Where base spans cover parts of a run, what is left of it on any side is tested by itself.
    """
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    found, at = list(base), 0
    for m in RUN.finditer(text):
        while at < len(base) and base[at][2] <= m.start():
            at += 1
        end = at
        while end < len(base) and base[end][0] < m.end():
            end += 1
        for a, b in _outside(m.start(), m.end(), base[at:end]):
            if b - a >= REST and looks_random(text[a:b], tokens, ratio):
                found.append((a, 3, b))
    return sorted(found)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every span, overlapping ones together, replaced by the mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = "array<struct<kind:string,start:int,end:int>>"


def scan(
    docs: DataFrame,
    vocabulary: Vocabulary,
    id_column: str = "doc_id",
    text_column: str = "text",
    ratio: float = RATIO,
) -> DataFrame:
    """Per row: id and `spans`, all secrets by start, then kind; offsets in code points.

    A null text counts as empty. Repeated rows stay repeated, other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_in(vocabulary)
        for batch in slices(batches):
            found = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t, tokens, ratio)]
                for t in batch.column(1).to_pylist()
            ]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans {_SPAN}").select(F.col("id").alias(id_column), "spans")


def digest_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redacted(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text_column: str = "text",
    size_column: str | None = "n_chars",
    mark: str = "<secret>",
    ratio: float = RATIO,
) -> DataFrame:
    """`docs` with every secret replaced by the mark and the size column set anew.

    Rows without a secret stay as they are, null texts too. A table without the size column is fine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_in(vocabulary)
        for batch in slices(batches):
            out = []
            for text in batch.column(0).field(at).to_pylist():
                spans = spans_of(text or "", tokens, ratio)
                out.append(redact(text, spans, mark) if spans else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), batch.column(0)], ["_new", "_row"])

    at = position(docs, text_column)  # read from the row, so that a text travels once
    rows = docs.select(F.struct("*").alias("_row"))
    rows = rows.mapInArrow(run, StructType([StructField("_new", StringType()), rows.schema["_row"]]))
    new, columns = F.col("_new"), []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        changed = {text_column: new, size_column: F.length(new).cast(docs.schema[c].dataType)}.get(c)
        columns.append((old if changed is None else F.when(new.isNotNull(), changed).otherwise(old)).alias(c))
    return rows.select(*columns)
