"""Paths like ``['a'][:2][0]`` compiled once to a Column chain; nothing is evaluated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\[([^\[\]]*)\]")


def str_to_slice(text: str) -> slice:
    """``1:``, ``::-1`` or ``[:1]`` as a slice; an index is none."""
    inner = text.strip()
    inner = inner[1:-1] if inner.startswith("[") and inner.endswith("]") else inner
    parts = inner.split(":")
    if not 2 <= len(parts) <= 3 or not all(re.fullmatch(r"\s*-?\d*\s*", p) for p in parts):
        raise ValueError(f"not a slice: {text!r}")
    return slice(*[int(p) if p.strip() else None for p in parts])


def sliced(array: Column, part: slice) -> Column:
    """A Python slice (steps 1 and -1) of an array column."""
    n = F.size(array)
    if part.step == -1:
        if part.start is not None or part.stop is not None:
            raise ValueError("a reversed slice takes the whole array")
        return F.reverse(array)
    if part.step not in (None, 1):
        raise ValueError(f"step {part.step} is not supported")
    at = lambda x, default: default if x is None else F.least(n, F.lit(x)) if x >= 0 else F.greatest(F.lit(0), n + x)
    start, stop = at(part.start, F.lit(0)), at(part.stop, n)
    return F.slice(array, start + 1, F.greatest(F.lit(0), stop - start))


def parse(path: str) -> list[str | int | slice]:
    """The steps of a path: quoted or bare names, whole numbers, slices."""
    if _STEP.sub("", path).strip():
        return parse(f"[{path}]") if "[" not in path else _bad(path)
    steps: list[str | int | slice] = []
    for inner in _STEP.findall(path):
        inner = inner.strip()
        if inner[:1] in "'\"" and inner[:1]:
            steps.append(inner[1:-1])
        elif re.fullmatch(r"-?\d+", inner):
            steps.append(int(inner))
        elif ":" in inner:
            steps.append(str_to_slice(inner))
        else:
            steps.append(inner)
    return steps


def _bad(path: str):
    raise ValueError(f"not a path: {path!r}")


def item(column: Column, path: str) -> Column:
    """The part of a struct, map or array column that the path names; null out of range."""
    for step in parse(path):
        if isinstance(step, slice):
            column = sliced(column, step)
        elif isinstance(step, int):
            column = F.get(column, F.lit(step) if step >= 0 else F.size(column) + step)
        else:
            column = column[step]
    return column
