"""Operator 2, token counts: byte-pair merging with a heap over a linked list.

The text is cut as the byte-level pre-tokeniser cuts it; each piece becomes a chain of byte
symbols; the adjacent pair of lowest rank (leftmost on ties) is popped and merged until no
known pair is left. The count is the number of symbols less the number of merges; no
identifier is looked up anywhere.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); the strings of special tokens
are one token each, as the library's default has it; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that a worker keeps of words seen before; at the bound it starts anew.
CACHE_ENTRIES = 600_000
#: Words of more characters are merged anew each time.
CACHE_CHARS = 64

_ADJACENT_SPACE = re.compile(r"\s\s")


class Memo(dict):
    """A bounded memo: ``memo[word]`` computes what is not there yet."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = value
        return value


def byte_letters() -> list[str]:
    """The printable letter that the vocabulary file writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merges(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How often two neighbours merge, lowest rank first and leftmost on ties."""
    after = [*range(1, len(symbols)), -1]
    before = [*range(-1, len(symbols) - 1)]
    live = list(symbols)
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(live, live[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if live[i] != a or j < 0 or live[j] != b:
            continue
        live[i], live[j] = a + b, ""
        done += 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((live[i], live[k]))) is not None:
                heapq.heappush(heap, (r, i, live[i], live[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((live[h], live[i]))) is not None:
            heapq.heappush(heap, (r, h, live[h], live[i]))
    return done


def spaced(text: str) -> list[str] | None:
    """Words that the pre-tokeniser never joins: cut before each single space or line break.

    None if white space meets white space or an end of the text, where a cut isn't safe.
    """
    if not text or text[0].isspace() or text[-1].isspace() or _ADJACENT_SPACE.search(text):
        return None
    return text.replace("\n", " \n").split(" ")


def unspaced(word: str) -> str:
    """The text that a word of spaced(), but not the first, stands for."""
    return word if word.startswith("\n") else f" {word}"


class TokenCounter:
    """Counts of tokens under one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = spec["model"]["merges"]
        self.ranks = {tuple(p.split(" ") if isinstance(p, str) else p): r for r, p in enumerate(pairs)}
        self.letters = byte_letters()
        self.cut = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.of_piece = Memo(self._piece)
        self.of_word = Memo(lambda word: self._cut_and_count(unspaced(word)))

    def _piece(self, piece: str) -> int:
        symbols = [self.letters[b] for b in piece.encode()]
        return len(symbols) - merges(symbols, self.ranks)

    def _cut_and_count(self, text: str) -> int:
        return sum(map(self.of_piece.__getitem__, self.cut.findall(text)))

    def _plain(self, text: str) -> int:
        if (words := spaced(text)) is None:
            return self._cut_and_count(text)
        first, *rest = words
        return self._cut_and_count(first) + sum(map(self.of_word.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return len(self.special.findall(text)) + sum(map(self._plain, self.special.split(text)))


@functools.lru_cache(2)
def counter(path: str) -> TokenCounter:
    """One counter a worker process and file."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 512) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` of every whole text; no shuffle.

    vocabulary: a byte-level BPE file of the tokenizers library, there on every executor.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("bigint")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(path).count
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("bigint").alias("n_bytes"), tokens(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
