"""Error rates as ratios of sums, by several keys at once, and word errors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(scores: DataFrame, keys: list[str], levels: list[list[str]]) -> DataFrame:
    """``*keys, errors, length, error_rate`` for each level (a subset of the keys; a key that a
    level leaves out is null): one pass of grouping sets."""
    sets = [[F.col(k) for k in level] for level in levels]
    summed = scores.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.sum("errors").alias("errors"), F.sum("length").alias("length"))
    return summed.withColumn("error_rate", F.col("errors") / F.col("length"))


def of_reference_keys(scores: DataFrame, key: str, reference: DataFrame) -> DataFrame:
    """Only the scores whose key the reference set has."""
    return scores.join(reference.select(key).distinct(), key, "left_semi")


def leave_one_out(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``others``: the key's sum without the row's own value."""
    total = rows.groupBy(*keys).agg(F.sum(value).alias("_total"))
    return rows.join(total, keys).withColumn("others", F.col("_total") - F.col(value)).drop("_total")


def edit_distance(a: list[str], b: list[str]) -> int:
    """Substitutions, insertions and deletions between two word lists.

    The row of distances for each word of the shorter list is kept as its steps from place to place of
    the longer one, bits of two whole numbers: where it rises by one, and where it falls.
    """
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    places: dict[str, int] = {}
    for i, w in enumerate(many):
        places[w] = places.get(w, 0) | 1 << i
    every = (1 << len(many)) - 1
    last = 1 << len(many) >> 1
    rises, falls, distance = every, 0, len(many)
    for w in few:
        same = places.get(w, 0)
        level = ((((same & rises) + rises) ^ rises) | same) & every
        up, down = falls | (every & ~(level | rises)), rises & level
        distance += bool(up & last) - bool(down & last)
        up, down, kept = (up << 1 | 1) & every, (down << 1) & every, same | falls
        rises, falls = down | (every & ~(kept | up)), up & kept
    return distance if many else 0


def word_errors(rows: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """``errors, length`` of each row's hypothesis against its reference; null counts as empty."""

    @F.pandas_udf("errors bigint, length bigint")
    def count(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for refs, hyps in batches:
            pairs = [((r or "").split(), (h or "").split()) for r, h in zip(refs, hyps)]
            yield pd.DataFrame([(edit_distance(r, h), len(r)) for r, h in pairs], columns=["errors", "length"])

    scored = rows.withColumn("_s", count(reference, hypothesis))
    return scored.withColumns({"errors": F.col("_s.errors"), "length": F.col("_s.length")}).drop("_s")
