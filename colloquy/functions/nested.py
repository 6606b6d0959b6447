"""Nested values: leaves of arrays, fields by path, files by kind, names in natural order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_leaves(column: Column, depth: int, f: Callable[[Column], Column]) -> Column:
    """``f`` on the elements of arrays nested ``depth`` deep."""
    return f(column) if depth == 0 else F.transform(column, lambda x: map_leaves(x, depth - 1, f))


def with_path(column: Column, path: str, value: Column) -> Column:
    """A struct column with the field at ``a.b.c`` set."""
    return column.withField(path, value)


def kept_by_kind(kind: Column, name: Column, patterns: dict[str, str | None]) -> Column:
    """Whether a file of a known kind is kept: its name must match the kind's pattern (None: all
    are kept). An unknown kind is an error."""
    keep = F.when(F.lit(False), False)
    for known, pattern in patterns.items():
        keep = keep.when(kind == known, F.lit(True) if pattern is None else name.rlike(f"^(?:{pattern})"))
    return keep.otherwise(F.raise_error(F.concat(F.lit("unknown kind: "), kind)).cast("boolean"))


def natural_order(name: Column) -> list[Column]:
    """Sort keys that put ``x_9`` before ``x_10``: the name without its last number, the number."""
    number = F.regexp_extract(name, r"(\d+)(?!.*\d)", 1)
    return [F.regexp_replace(name, r"\d+(?!.*\d)", ""), F.nullif(number, F.lit("")).cast("bigint")]
