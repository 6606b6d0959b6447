"""Operator 5, language ID: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed counts of 1- to 3-grams of the lower-cased characters. Document frequencies
come from every training document. The weights are fitted on a bounded sample of labelled rows
by follow-the-regularised-leader with elastic-net penalties, which leaves them sparse, and a
temperature fitted on sampled rows that training did not see calibrates the scores.

Defined cases: a text that is null or has no letter is ``und`` with score 0; without labelled
training rows every text is ``und``; with one language every other text is that one; rows with a
null language are never learned from; repeated rows are predicted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """``sample`` is the bound on labelled rows of each language that the weights are fitted on."""

    dims: int = 1 << 14
    orders: tuple[int, ...] = (1, 2, 3)
    sample: int = 500
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.1


@dataclass
class Model:
    """``weights`` (dims x languages) are those on plain counts; ``idf`` gives the norm."""

    settings: Settings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    nonzero: float = field(default=0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        x = tf(counts(text, self.settings)) * self.idf
        z = (x @ self.weights / max(np.sqrt(x @ x), 1e-12) + self.bias) / self.temperature
        p = softmax(z.astype(np.float64))
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def counts(text: str, settings: Settings) -> np.ndarray:
    """How often each hashed n-gram occurs in the lower-cased text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    total = np.zeros(settings.dims, dtype=np.float32)
    h = np.zeros(len(c), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(settings.orders) + 1):
            if len(c) < n:
                break
            h = h[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n)
            if n in settings.orders:
                total += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - settings.dims.bit_length() + 1), minlength=settings.dims)
    return total


def tf(c: np.ndarray) -> np.ndarray:
    return np.log1p(c)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def document_frequencies(rows: DataFrame, settings: Settings) -> tuple[int, np.ndarray]:
    """Documents, and how many have each feature: at most ``dims`` rows leave a task."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, n = np.zeros(settings.dims, dtype=np.int64), 0
        for batch in batches:
            for text in batch["_text"]:
                found += counts(text, settings) > 0
                n += 1
        at = np.flatnonzero(found)
        yield pd.DataFrame({"feature": np.append(at, -1), "n": np.append(found[at], n)})

    df = np.zeros(settings.dims)
    total = 0
    for feature, n in rows.select("_text").mapInPandas(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n")).collect():
        if feature < 0:
            total = n
        else:
            df[feature] = n
    return total, df


def sampled(rows: DataFrame, settings: Settings) -> DataFrame:
    """At most ``sample`` rows of each language, those of the smallest hash of the id; equal rows
    count once, so that a row that is repeated is no more than one."""
    rows = rows.withColumn("_t", F.xxhash64("_text"))
    small = rows.select("_id", "_lang", "_t").distinct().select("*", F.xxhash64("_id").alias("_h"), F.spark_partition_id().alias("_part"))
    # First within the partitions, then among what is left: a frequent language is no hot group.
    for by in (["_lang", "_part"], ["_lang"]):
        small = small.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "_id", "_t"))).where(F.col("_r") <= settings.sample)
    picked = small.select("_id", "_lang", "_t")
    return rows.join(F.broadcast(picked), ["_id", "_lang", "_t"], "left_semi").dropDuplicates(["_id", "_lang", "_t"]).drop("_t")


def _sparse(rows: DataFrame, settings: Settings) -> DataFrame:
    """Language, fold and the non-zero counts of each row."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, lang, f, text in zip(batch["_h"], batch["_lang"], batch["_fold"], batch["_text"]):
                c = counts(text, settings)
                at = np.flatnonzero(c)
                out.append((key, lang, f, at.astype("<u2").tobytes(), c[at].astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["h", "lang", "fold", "at", "c"])

    rows = rows.select(F.xxhash64("_id").alias("_h"), "_lang", "_fold", "_text")
    return rows.mapInPandas(extract, "h bigint, lang string, fold bigint, at binary, c binary")


def follow_the_regularised_leader(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_languages: int, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``epochs`` passes of per-coordinate FTRL-proximal updates."""
    s = settings
    z, n = np.zeros((s.dims + 1, n_languages)), np.zeros((s.dims + 1, n_languages))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - s.l1, 0)
        return -shrunk / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2)

    rng = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            w = weights(at)
            p = softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / s.alpha * w
            n[at] = grown
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search of its log."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    low, high, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Model:
    """A model of the rows whose fold is not 0 and whose language and text are not null.

    The driver holds the sampled rows' features, the document frequencies and the weights: all
    bounded by the settings and the number of languages.
    """
    settings = settings or Settings()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), fold(id_col).alias("_fold"))
    rows = rows.where("_fold <> 0 AND _text IS NOT NULL AND _lang IS NOT NULL")
    total, df = document_frequencies(rows, settings)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    got = sorted(_sparse(sampled(rows, settings), settings).collect(), key=lambda r: (r["h"], r["lang"], bytes(r["at"])))
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return Model(settings, [], idf, np.zeros((settings.dims, 0), np.float32), np.zeros(0))
    x, y, folds = [], [], []
    for r in got:
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        v = tf(np.frombuffer(r["c"], "<f4")) * idf[at]
        norm = max(float(np.sqrt(v @ v)), 1e-12)
        x.append((np.append(at, settings.dims), np.append(v / norm, 1.0)))
        y.append(languages.index(r["lang"]))
        folds.append(r["fold"])
    y, calibrating = np.array(y), np.array(folds) == 1
    train = np.flatnonzero(~calibrating) if not calibrating.all() else np.arange(len(y))
    w, bias = follow_the_regularised_leader([x[i] for i in train], y[train], len(languages), settings)
    model = Model(settings, languages, idf, w.astype(np.float32), bias, nonzero=float((w != 0).mean()))
    if len(languages) > 1 and calibrating.any():
        full = np.vstack([w, bias])
        logits = np.array([v @ full[at] for (at, v), c in zip(x, calibrating) if c])
        model.temperature = temperature(logits, y[calibrating])
    return model


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *keep, lang_pred, score`` of every whole text; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    once = predict.asNondeterministic()  # a filter on the result must not run it again
    rows = docs.select(F.col(id_col), *keep, once(F.col(text_col)).alias("_p"))
    return rows.select(id_col, *keep, "_p.lang_pred", "_p.score")
