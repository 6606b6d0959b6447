"""The cheapest one-to-one assignment of two small sets, for each row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def cheapest(cost: np.ndarray) -> list[int]:
    """Of a matrix with no more rows than columns, the column of each row at the least total cost.

    Shortest augmenting paths with potentials, cubic in the size.
    """
    n, m = cost.shape
    of_row, of_column = np.zeros(n + 1), np.zeros(m + 1)
    row_at = np.zeros(m + 1, int)  # the row, from 1 on, that has each column
    for row in range(1, n + 1):
        row_at[0], at = row, 0
        least, came, seen = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_at[at]:
            seen[at] = True
            here = cost[row_at[at] - 1] - of_row[row_at[at]] - of_column[1:]
            nearer = ~seen[1:] & (here < least[1:])
            least[1:][nearer], came[1:][nearer] = here[nearer], at
            open_ = np.where(seen, np.inf, least)
            open_[0] = np.inf
            following = int(open_.argmin())
            step = open_[following]
            of_row[row_at[seen]] += step
            of_column[seen] -= step
            least[~seen] -= step
            at = following
        while at:
            row_at[at], at = row_at[came[at]], came[at]
    found = [0] * n
    for column in range(1, m + 1):
        if row_at[column]:
            found[row_at[column] - 1] = column - 1
    return found


def least_total(pairs: Sequence[dict], unmatched_a: dict, unmatched_b: dict) -> int:
    """The least sum over pairings: the values of pairs ``a, b, v``, and what each one costs that has no
    partner. Pairs that aren't listed cost what both cost alone."""
    rows, columns = sorted(unmatched_a), sorted(unmatched_b)
    n = len(rows) + len(columns)
    cost = np.zeros((n, n))
    for i, a in enumerate(rows):
        cost[i, : len(columns)] = [unmatched_a[a] + unmatched_b[b] for b in columns]
        cost[i, len(columns) :] = unmatched_a[a]
    cost[len(rows) :, : len(columns)] = [[unmatched_b[b] for b in columns]] * len(columns)
    at_a, at_b = {a: i for i, a in enumerate(rows)}, {b: j for j, b in enumerate(columns)}
    for p in pairs:
        cost[at_a[p["a"]], at_b[p["b"]]] = p["v"]
    return int(round(sum(cost[i, j] for i, j in enumerate(cheapest(cost))))) if n else 0


def least_totals(pairs: Column, alone_a: Column, alone_b: Column) -> Column:
    """least_total() of each row: ``array<struct<a, b, v>>`` and two ``array<struct<k, v>>``, as many
    as a session has speakers; null arrays are empty."""
    listed = lambda x: [] if x is None else list(x)
    costs = lambda x: {r["k"]: r["v"] for r in listed(x)}

    @F.pandas_udf("bigint")
    def solve(pairs: pd.Series, alone_a: pd.Series, alone_b: pd.Series) -> pd.Series:
        return pd.Series([least_total(listed(p), costs(a), costs(b)) for p, a, b in zip(pairs, alone_a, alone_b)], dtype="int64")

    return solve(pairs, alone_a, alone_b)
