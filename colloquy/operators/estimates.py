"""A table function over the pieces of segments: whatever a stateful estimator makes of each."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Takes the place and the values of one piece after the other, gives rows.
Estimator = Callable[[int, list], Iterable[tuple]]


def estimated(pieces: DataFrame, segment: list[str], make: Callable[[], Estimator], schema: str) -> DataFrame:
    """``*segment`` and the columns of ``schema``: a new estimator for each segment, fed in order of ``at``.

    A worker holds one piece at a time, and the estimator's own state; segments are spread over tasks by
    all their columns, so one recording's segments needn't share a task.
    """
    kept = StructType([pieces.schema[c] for c in segment])
    out = StructType([*kept.fields, *StructType.fromDDL(schema).fields])

    class Estimates:
        def __init__(self) -> None:
            self.estimate: Estimator | None = None

        def eval(self, row: Any) -> Iterable[tuple]:
            if self.estimate is None:
                self.estimate = make()
            head = tuple(row[c] for c in segment)
            for result in self.estimate(row["at"], row["values"]):
                yield (*head, *result)

    table = pieces.select(*segment, "at", "values").asTable().partitionBy(*segment).orderBy("at")
    return F.udtf(Estimates, returnType=out)(table)


def differences() -> Estimator:
    """``frame, value``: each value less the one before it, the first as it is."""
    last = 0

    def run(at: int, values: list) -> Iterable[tuple]:
        nonlocal last
        for i, x in enumerate(values):
            yield at + i, x - last
            last = x

    return run
