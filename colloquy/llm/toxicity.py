"""Operator 13, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned from labelled texts: words, beginnings of words and words freed of disguise
(digits and signs for letters, doubled letters, signs between letters) that toxic texts have more
often than others. A text's features are the densities of lexicon entries, how close they are to
words of the second person, rates of capitals, punctuation and disguise. The lexicon, the trees
and the calibration are each fitted on rows of their own, so that none is judged on what it has seen.

``Settings.sample`` bounds the labelled documents of each label that are learned from; they are
weighted, so that the scores follow the share of the label among all labelled documents.

Defined cases: a null text is the empty text, and is scored; labels that are null, or neither 0 nor
1, are not learned from; a document is toxic if one of its labels is; equal texts of one label are
learned from once; rows without an id have no label, and are held out; without labelled documents
every score is 0, with one label only it is that label; repeated rows are scored alike; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import fold
from .tables import discard, written


@dataclass(frozen=True)
class Settings:
    """``sample``: labelled documents of each label at most; ``entries``: lexicon entries of each kind
    at most; ``strong`` and ``weak``: strengths of an entry (natural log-odds, two standard errors less); ``near``: words between an entry and a
    word of the second person."""

    sample: int = 4000
    entries: int = 2000
    strong: float = 2.0
    weak: float = 0.7
    stems: tuple[int, ...] = (4, 5, 6)
    near: int = 4
    trees: int = 20
    depth: int = 3
    lexicon_folds: tuple[int, ...] = (1, 2)
    tree_folds: tuple[int, ...] = (3,)


#: Words of the second person in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu toi te ton ta vous votre vos tú tu ti usted ustedes tus vosotros".split())
#: Signs that stand for letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
WORD = re.compile(r"[^\s]+")
_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_INNER = re.compile(r"[\W_]+")
_TWICE = re.compile(r"(.)\1+")

FEATURES = (
    "strong_words", "strong_stems", "weak_words", "weak_stems", "disguised_entries", "strongest_word", "strongest_stem", "strong_entries", "entries_near_you", "second_person",
    "capitals", "capital_words", "exclamations", "questions", "other_signs", "disguised_words", "long_runs", "log_words", "mean_length",
)
#: Words whose entries a task remembers.
REMEMBERED = 200_000


@dataclass
class Lexicon:
    """Strengths of words, and of beginnings of words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


@dataclass
class Model:
    """Without trees, every text has the score ``constant``."""

    settings: Settings
    lexicon: Lexicon
    constant: float = 0.0
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def plain(token: str) -> str:
    """A lower-cased token without signs at its ends."""
    return _EDGE.sub("", token.lower())


def undisguised(word: str) -> str:
    """A word with letters for signs, without signs between letters, and with single letters."""
    return _TWICE.sub(r"\1", _INNER.sub("", word.translate(DISGUISES)))


def terms(text: str, settings: Settings) -> set[tuple[int, str]]:
    """The different words (kind 0) and beginnings of words (kind 1) of a text."""
    found = set()
    for word in {plain(t) for t in WORD.findall(text)}:
        found |= {(0, word), (0, undisguised(word))}
        found |= {(1, word[:n]) for n in settings.stems if len(word) >= n}
    return found - {(0, "")}


def entry_of(token: str, lexicon: Lexicon, settings: Settings) -> tuple[float, float, bool, bool, bool, bool]:
    """Strengths of the token as a word and as a stem (0: none), and whether the entry was disguised,
    whether the token is of the second person, in capitals, and has signs or digits inside."""
    word = plain(token)
    clean = word if word.isalpha() else undisguised(word)
    z, disguised = lexicon.words.get(word, 0.0), False
    if not z:
        z = lexicon.words.get(undisguised(word), 0.0)
        disguised = z > 0
    stem = max((lexicon.stems.get(clean[:n], 0.0) for n in settings.stems if len(clean) >= n), default=0.0)
    return z, stem, disguised, word in SECOND_PERSON, len(token) > 1 and token.isupper(), not word.isalpha() and word != "" and any(map(str.isalpha, word))


def features(text: str | None, lexicon: Lexicon, settings: Settings, seen: dict) -> list[float]:
    """The numbers named in FEATURES; ``seen`` remembers tokens."""
    text = text or ""
    tokens = WORD.findall(text)
    n, chars = max(len(tokens), 1), max(len(text), 1)
    strong = [0, 0]
    weak = [0, 0]
    disguised = people = capitals = odd = 0
    top, entries, second = [0.0, 0.0], [], []
    for at, token in enumerate(tokens):
        got = seen.get(token)
        if got is None:
            if len(seen) >= REMEMBERED:
                seen.clear()
            got = entry_of(token, lexicon, settings)
            seen[token] = got = got if any(got) else ()
        if not got:
            continue
        z, stem, hidden, person, shouted, signs = got
        for kind, score in enumerate((z, stem)):
            strong[kind] += score >= settings.strong
            weak[kind] += score > 0
            top[kind] = max(top[kind], score)
        if max(z, stem) >= settings.strong:
            entries.append(at)
        disguised += hidden
        people += person
        capitals += shouted
        odd += signs
        if person:
            second.append(at)
    near = 0
    if entries and second:
        places = np.searchsorted(second, entries)
        around = np.array([-(1 << 40), *second, 1 << 40])
        gap = np.minimum(np.abs(around[places] - entries), np.abs(around[places + 1] - entries))
        near = int((gap <= settings.near).sum())
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks, asked = text.count("!"), text.count("?")
    signs = sum(text.count(c) for c in "#*$%&|<>@_~^=+")
    per = 100.0 / n
    return [
        strong[0] * per, strong[1] * per, weak[0] * per, weak[1] * per, disguised * per, *top, float(np.log1p(len(entries))), near * per, people * per,
        upper / chars, capitals / n, marks / n, asked / n, signs / n, odd / n, len(_RUN.findall(text)) / n, float(np.log1p(len(tokens))), len(text) / n,
    ]


_RUN = re.compile(r"(\w)\1{3,}")


def labelled(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, dict[int, int]]:
    """``id, fold, toxic, text`` of the documents that are learned from, written, and how many
    labelled documents there are of each label."""
    toxic = F.col(label_col).cast("int")
    rows = labels.select(F.col(id_col).cast("bigint").alias("id"), toxic.alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    rows = rows.withColumn("fold", fold("id")).where("fold <> 0").groupBy("id", "fold").agg(F.max("toxic").alias("toxic"))
    many = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    rows = rows.select("*", F.xxhash64("id").alias("_h"), F.spark_partition_id().alias("_part"))
    # First within the partitions, then among what is left: a frequent label is no hot group.
    for by in (["toxic", "_part"], ["toxic"]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "id"))).where(F.col("_r") <= settings.sample)
    picked = rows.select("id", "fold", "toxic")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # At most ``sample`` rows of each label are broadcast.
    found = texts.join(F.broadcast(picked), "id").withColumn("_t", F.xxhash64("text"))
    first = Window.partitionBy("toxic", "_t").orderBy("fold", "id")
    return written(found.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("id", "fold", "toxic", "text")), many


def learned_lexicon(rows: DataFrame, settings: Settings) -> Lexicon:
    """The entries of ``toxic, text`` that toxic texts have more often than others, beyond doubt."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                found = terms(text, settings)
                if found:
                    yield pd.DataFrame({"kind": [k for k, _ in found], "term": pd.Series([t for _, t in found], dtype=object), "toxic": toxic})

    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    clean = n - toxic
    found = rows.select("toxic", "text").mapInPandas(each, "kind int, term string, toxic int").groupBy("kind", "term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") - F.col("a") + 0.5
    strength = F.log(a / (toxic + 1 - a)) - F.log(b / (clean + 1 - b)) - 2 * F.sqrt(1 / a + 1 / b)
    found = found.where("a >= 2").withColumn("strength", strength).where(F.col("strength") >= settings.weak)
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("strength").desc(), "term"))
    lexicon = Lexicon()
    for r in found.withColumn("_r", place).where(F.col("_r") <= settings.entries).collect():
        (lexicon.stems if r["kind"] else lexicon.words)[r["term"]] = r["strength"]
    return lexicon


def with_features(rows: DataFrame, text: Column, lexicon: Lexicon, settings: Settings) -> DataFrame:
    """``rows`` with ``features``, an array in the order of FEATURES."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)  # bounded by Settings.entries

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for texts in batches:
            yield pd.Series([features(t, shared.value, settings, seen) for t in texts], dtype=object)

    return rows.withColumn("features", array_to_vector(measure.asNondeterministic()(text)))


def boosted(rows: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """``rows`` with ``margin``, what the trees say."""
    model = model.copy().setFeaturesCol("features").setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("")
    return model.transform(rows).withColumn("margin", vector_to_array("_raw")[1]).drop("_raw")


def _both(rows: DataFrame) -> bool:
    return rows.select("toxic").distinct().count() == 2


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings | None = None) -> Model:
    """A model of the labelled documents whose fold is not 0.

    The lexicon comes from two folds, the trees from one and the calibration from another; a fold
    that lacks a label is replaced by all of them. The features of the sample are one sorted
    part (at most 2 * ``sample`` rows), so that every fit gives the same trees.
    """
    settings = settings or Settings()
    rows, many = labelled(docs, labels, settings, id_col, text_col, label_col)
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(seen) < 2:
        return Model(settings, Lexicon(), constant=float(max(seen, default=0)))
    folds = {"words": settings.lexicon_folds, "trees": settings.tree_folds, "scores": tuple({1, 2, 3, 4} - {*settings.lexicon_folds, *settings.tree_folds})}
    parts = {k: rows.where(F.col("fold").isin(*v)) for k, v in folds.items()}
    parts = {k: part if _both(part) else rows for k, part in parts.items()}
    lexicon = learned_lexicon(parts["words"], settings)
    weight = F.when(F.col("toxic") == 1, many[1] / seen[1]).otherwise(many[0] / seen[0])

    def measured(part: DataFrame) -> DataFrame:
        part = with_features(part, F.col("text"), lexicon, settings)
        return written(part.select("id", F.col("toxic").cast("double").alias("label"), weight.alias("weight"), "features").coalesce(1).sortWithinPartitions("id", "label"))

    train, held = measured(parts["trees"]), measured(parts["scores"])
    discard(rows)
    trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=settings.trees, maxDepth=settings.depth, stepSize=0.2, minInstancesPerNode=1, seed=13).fit(train)
    told = boosted(held, trees).select("label", "weight", "margin")
    calibration = IsotonicRegression(labelCol="label", weightCol="weight", featuresCol="margin").fit(told)
    discard(train)
    discard(held)
    return Model(settings, lexicon, trees=trees, calibration=calibration)


def scored(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *keep, score`` of every whole text, between 0 and 1; no shuffle."""
    if model.trees is None:
        return docs.select(id_col, *keep, F.lit(model.constant).alias("score"))
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    rows = boosted(with_features(rows, F.col("_text"), model.lexicon, model.settings).drop("_text"), model.trees)
    rows = model.calibration.copy().setFeaturesCol("margin").setPredictionCol("_score").transform(rows)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_score")))
    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)], score.alias("score"))
