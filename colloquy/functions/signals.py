"""Numeric kernels over signals that are arrays of a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import SAMPLE_RATE


def early(response: np.ndarray, start: int, seconds: float = 0.05, rate: int = SAMPLE_RATE) -> np.ndarray:
    """A room's response with what comes later than ``seconds`` after its start set to zero."""
    out = np.array(response, dtype=float)
    out[..., start + int(seconds * rate) :] = 0
    return out


def convolved(signal: np.ndarray, response: np.ndarray, tail: bool = True) -> np.ndarray:
    """The convolution on the last axis, over FFTs; other axes broadcast. Without the tail, as
    long as the signal."""
    n = signal.shape[-1] + response.shape[-1] - 1
    size = 1 << (n - 1).bit_length()
    out = np.fft.irfft(np.fft.rfft(signal, size) * np.fft.rfft(response, size), size)[..., :n]
    return out if tail else out[..., : signal.shape[-1]]


def early_reverberated(signal: Column, response: Column, start: Column) -> Column:
    """A source's signal as the early part of a room's response makes it, as long as the source."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, r: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([convolved(np.asarray(a, float), early(np.asarray(b, float), int(k)), False).tolist() for a, b, k in zip(x, r, s)])

    return run(signal, response, start)
