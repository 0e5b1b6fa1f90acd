"""Vocabularies of byte-level BPE tokenizers, given as rank files.

The driver reads the file, whose size the vocabulary bounds, and ships its bytes with each
function, so executors need no such file. Tokenizers are built once a task, when first used.
"""

from __future__ import annotations

import base64
from pathlib import Path

import public_tokenizers

#: The vocabulary and pre-token pattern that the queries use.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Vocabulary:
    """The ranks of a tokenizer file and the pattern that cuts text into pre-tokens."""

    def __init__(self, path: str | None = None, pattern: str = public_tokenizers.PATTERN):
        self.raw = Path(path or public_tokenizers.path(VOCABULARY)).read_bytes()
        self.pattern = pattern

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}

    def encoding(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
