"""Transcript clean-up and scoring forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(words: Column) -> Column:
    """Without ``? , . !``, with hyphens as spaces, trimmed; null when nothing is left."""
    return F.nullif(F.trim(F.translate(words, "-?,.!", " ")), F.lit(""))


def scored(words: Column) -> Column:
    """Lower case without ``. ? ! ,``."""
    return F.translate(F.lower(words), ".?!,", "")


def squashed(words: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(F.trim(F.regexp_replace(words, r"\s+", " ")), " +", " ")


def uppercase_keeping_original(words: Column, original: Column) -> tuple[Column, Column]:
    """``words`` in upper case, and the original words, kept if there already."""
    return F.upper(words), F.coalesce(original, words)


def without_ansi(line: Column) -> Column:
    return F.regexp_replace(line, "\x1b\\[[0-9;]*[A-Za-z]", "")


def percent(rate: Column) -> Column:
    """A rate as percent with two digits, ``-`` for none."""
    return F.coalesce(F.format_string("%.2f", rate * 100), F.lit("-"))
