"""Words and shingles of many texts at once, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

#: Bytes of text that are worked on at once, besides what a single longer text or word needs.
CHUNK = 1 << 20

_RNG = np.random.default_rng(20_240_501)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _STEP), ("down", _STEP_BACK)):
            steps = np.full(max(n, CHUNK), base)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Hashes of all words of some texts; text ``t`` has those from ``first[t]`` to ``first[t + 1]``."""

    hashes: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all shingles in order, and where each text's begin, as in ``first``.

        A text with fewer words has its whole sequence as one; one without words has none.
        """
        n = self.counts()
        each = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
        first = np.concatenate([[0], np.cumsum(each)])
        start = np.repeat(self.first[:-1] - first[:-1], each) + np.arange(first[-1])
        end = np.repeat(self.first[1:], each)
        total = np.full(len(start), np.uint64(width))
        for k in range(width):
            at = start + k
            there = at < end
            total += np.where(there, self.hashes[np.minimum(at, len(self.hashes) - 1)] * _PLACE[k], np.uint64(0)) if len(self.hashes) else np.uint64(0)
        return mix(total), first


def words(texts: Sequence[bytes]) -> Words:
    """The words of texts (none for an empty one), parted by ASCII white space."""
    joined = b" " + b" ".join(texts) + b" "
    a = np.frombuffer(joined, dtype=np.uint8)
    space = _IS_SPACE[a]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]) + 1)
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _powers(high - low)
        total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[a[low:high]] * up, dtype=np.uint64)])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return Words(out, first)


def chunks(texts: Sequence[bytes | None]) -> Iterator[tuple[int, list[bytes]]]:
    """The number of a first text and the texts from there, about CHUNK bytes at once."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t or b""
        if held and size + len(t) > CHUNK:
            yield first, held
            first, size, held = i, 0, []
        held.append(t)
        size += len(t)
    if held:
        yield first, held
