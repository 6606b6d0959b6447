"""Operator 3, SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into a normaliser (white space to U+2581, a dummy prefix), a lexicon
of pieces and byte-fallback arcs. Composed with a text, this gives a lattice whose arcs are the
pieces that match; the output is its shortest path in the tropical semiring. For a unigram model
an arc weighs its negative score. For a byte-pair model the lattice is also composed with the
automaton of piece pairs that merging leaves side by side: other pairs weigh infinity, so each
position has one finite path, which is the merging's own segmentation.

No piece goes past a U+2581 that follows another character, nor past a character outside the
lexicon, so the lattice is cut there and the path of each part is remembered.

Defined cases: a null or empty text has no pieces and decodes to an empty text; repeated rows
are encoded alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .bpe import Memo

SPACE = "▁"
#: Pairs of pieces that a worker remembers; at the bound it starts anew.
PAIR_ENTRIES = 400_000
#: More than any path of pieces weighs: an arc of byte fallback is taken only where no piece is.
FALLBACK = 1e12


class Transducer:
    """A compiled model file."""

    def __init__(self, path: str):
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normaliser, trainer = spec.normalizer_spec, spec.trainer_spec
        if normaliser.precompiled_charsmap or normaliser.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only an identity normaliser that keeps white space is compiled")
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.prefix = SPACE if normaliser.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces)}
        usable = [p for p in spec.pieces if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.score = {p.piece: p.score for p in usable}
        self.letters = {c for p in self.score for c in p}
        self.unknown = next(i for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.merging = trainer.model_type == trainer.BPE
        self.lexicon = {p for p in self.score if not self.merging or self.merged(p) == [p]}
        self.beginnings = {p[:i] for p in self.lexicon for i in range(1, len(p) + 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.of_part = Memo(self._part)
        if any(SPACE in p.lstrip(SPACE) for p in self.lexicon):
            self.parts = None
        else:
            known = "".join(re.escape(c) for c in sorted(self.letters - {SPACE}))
            self.parts = re.compile(f"{SPACE}*[{known}]+|{SPACE}+|[^{SPACE}{known}]")
        self.output = [p.piece.replace(SPACE, " ").encode() for p in spec.pieces]
        for i, p in enumerate(spec.pieces):
            if p.type == kinds.BYTE:
                self.output[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.CONTROL:
                self.output[i] = b""
            elif p.type == kinds.UNKNOWN:
                self.output[i] = trainer.unk_surface.encode()

    def merged(self, text: str) -> list[str]:
        """A short text's symbols after merging, best score first and leftmost on ties."""
        symbols, score = list(text), self.score
        scores = [score.get(a + b, -math.inf) for a, b in zip(symbols, symbols[1:])]
        while scores and (best := max(scores)) > -math.inf:
            i = scores.index(best)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score.get(symbols[i - 1] + symbols[i], -math.inf)
            if i < len(scores):
                scores[i] = score.get(symbols[i] + symbols[i + 1], -math.inf)
        return symbols

    def side_by_side(self, a: str, b: str) -> bool:
        """Whether merging leaves the two pieces as they are."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return known

    def path(self, text: str) -> list[str]:
        """The pieces on the shortest path of the lattice over a text."""
        return self.only_path(text) if self.merging else self.lightest_path(text)

    def lightest_path(self, text: str) -> list[str]:
        """By dynamic programming over the places of the text: any path may be finite."""
        n = len(text)
        distance, last = [0.0] + [math.inf] * n, [""] * (n + 1)
        for i in range(n):
            if (piece := text[i]) not in self.lexicon and distance[i] + FALLBACK < distance[i + 1]:
                distance[i + 1], last[i + 1] = distance[i] + FALLBACK, piece
            j = i + 1
            while j <= n and (piece := text[i:j]) in self.beginnings:
                if piece in self.lexicon and distance[i] - self.score[piece] < distance[j]:
                    distance[j], last[j] = distance[i] - self.score[piece], piece
                j += 1
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def only_path(self, text: str) -> list[str]:
        """Depth first, longest piece first: the one path of finite weight is the shortest.

        One path at most leads to each place, so a place that was left in vain stays shut.
        """
        n, lexicon, beginnings, pairs = len(text), self.lexicon, self.beginnings, self.pairs
        out: list[str] = []
        at, before, shut, longest = 0, "", set(), 0
        while at < n:
            if not longest:
                longest = 1
                while at + longest < n and text[at : at + longest + 1] in beginnings:
                    longest += 1
            for size in range(longest, 0, -1):
                piece = text[at : at + size]
                if piece in lexicon:
                    if at and (fits := pairs.get((before, piece))) is None:
                        fits = self.side_by_side(before, piece)
                    if at and not fits:
                        continue
                elif size > 1:
                    continue
                if at + size not in shut:
                    out.append(piece)
                    at, before, longest = at + size, piece, 0
                    break
            else:
                shut.add(at)
                longest = len(before) - 1
                at -= len(out.pop())
                before = out[-1] if out else ""
                while not longest:
                    shut.add(at)
                    longest = len(before) - 1
                    at -= len(out.pop())
                    before = out[-1] if out else ""
        return out

    def _part(self, text: str) -> bytes:
        ids = []
        for piece in self.path(text):
            if piece in self.lexicon:
                ids.append(self.ids[piece])
            elif self.bytes:
                ids += [self.bytes[b] for b in piece.encode("utf-8")]
            else:
                ids.append(self.unknown)
        return np.asarray(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids, as little-endian unsigned 32-bit bytes."""
        if not text:
            return b""
        text = self.prefix + text.replace(" ", SPACE)
        if self.parts is None:
            return self._part(text)
        return b"".join(map(self.of_part.__getitem__, self.parts.findall(text)))

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.output.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def transducer(path: str | None = None) -> Transducer:
    """One transducer a worker process and file."""
    return Transducer(path or public_tokenizers.path("piece_bpe_32k.model"))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id_col, ids`` (binary, little-endian unsigned 32-bit) of every whole text; no shuffle."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = transducer(model).encode
        for texts in batches:
            yield pd.Series([run(t) for t in texts], dtype=object)

    return docs.select(F.col(id_col), ids(F.col(text_col)).alias("ids"))


def decode(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``id_col, text`` of ids; null ids count as none."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = transducer(model).decode
        for ids in batches:
            yield pd.Series([run(x or b"") for x in ids], dtype=object)

    return encoded.select(F.col(id_col), text(F.col(ids_col)).alias("text"))


def encode_and_decode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``id_col, ids, text, decoded`` in one pass of the texts."""

    @F.pandas_udf("ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for texts in batches:
            ids = [t.encode(x) for x in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [t.decode(x) for x in ids]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("text"), both(text).alias("_b"))
    return rows.select(id_col, "text", "_b.ids", "_b.decoded")
