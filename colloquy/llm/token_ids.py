"""Token identifiers of whole texts, as little-endian unsigned 32-bit bytes.

Words between single spaces are never joined by the byte-level pre-tokeniser, so each word is
encoded once a task, or a worker, and remembered. The ranks come from the .tiktoken twin of the tokenizers
file (the same vocabulary, as ranks); tests hold the ids against the tokenizers library.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import public_tokenizers
import tiktoken

from .bpe import Memo, spaced, unspaced

SPECIAL = {"<|endoftext|>": 50256}


def as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class TokenIds:
    """The ids of the byte-level vocabulary in a .tiktoken file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        encoding = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut_and_encode = lambda text: as_bytes(encoding.encode_ordinary(text))
        self.of_word = Memo(lambda word: self.cut_and_encode(unspaced(word)))
        self.special = re.compile("(" + "|".join(map(re.escape, SPECIAL)) + ")")

    def _plain(self, text: str) -> bytes:
        if (words := spaced(text)) is None:
            return self.cut_and_encode(text)
        first, *rest = words
        return self.cut_and_encode(first) + b"".join(map(self.of_word.__getitem__, rest))

    def encode(self, text: str | None) -> bytes:
        """The ids of a text; strings of special tokens are special tokens, as the default is."""
        if not text:
            return b""
        if "<|" not in text:
            return self._plain(text)
        return b"".join(as_bytes([SPECIAL[part]]) if part in SPECIAL else self._plain(part) for part in self.special.split(text))


@functools.lru_cache(2)
def token_ids(path: str | None = None) -> TokenIds:
    """One encoder a worker process and file."""
    return TokenIds(path or public_tokenizers.path("byte_bpe_50k.tiktoken"))


@contextmanager
def encoding(path: str | None = None) -> Iterator[TokenIds]:
    """The encoder for one task. Workers outlive tasks; the words that this one remembers needn't."""
    encoder = token_ids(path)
    try:
        yield encoder
    finally:
        encoder.of_word.clear()
