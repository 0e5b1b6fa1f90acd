"""Small document tables with the awkward cases, and plain helpers."""

from __future__ import annotations

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0, **more):
    """Rows numbered from `first`; a pair (id, text) gives its own id."""
    rows = []
    for i, t in enumerate(texts):
        key, text = t if isinstance(t, tuple) else (first + i, t)
        rows.append((key, text, "en", "s", len(text) if text is not None else None))
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, words, vocabulary=400):
    random = np.random.default_rng(seed)
    names = ["".join(random.choice(list("abcdefghij"), random.integers(2, 8))) for _ in range(vocabulary)]
    return " ".join(random.choice(names, words))


AWKWARD = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "One word. Another word here.",
    "Ünï çôdé \U0001f600 text ÀÉ",
    "same text",
    "same text",
    "SAME text",
    "line\nline\n\nline\r\nother",
    "x" * 5000,
    "a b c d e f g h " * 30,
    "\x00nul\x7f and ﻿ mark",
]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
