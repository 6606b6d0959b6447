"""Element-wise work on vectors and signals as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_slice(a: Column, start: int | Column, stop: int | Column) -> Column:
    """Elements start to stop (exclusive), the first or last repeated beyond the ends."""
    start, stop = (F.lit(x) if isinstance(x, int) else x for x in (start, stop))
    return F.transform(F.sequence(start, stop - 1), lambda i: F.get(a, F.least(F.greatest(i, F.lit(0)), F.size(a) - 1)))


def upsample(a: Column, times: int, length: int | Column) -> Column:
    """Each element repeated, cut to ``length``."""
    return F.slice(F.flatten(F.transform(a, lambda x: F.array_repeat(x, times))), F.lit(1), F.lit(length) if isinstance(length, int) else length)


def _unit(x: Column) -> Column:
    """What isn't finite counts as 0; anything else outside of [0, 1] is an error."""
    x = F.when(F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")), 0.0).otherwise(x)
    return F.when((x >= 0) & (x <= 1), x).otherwise(F.raise_error(F.lit("values are outside of [0, 1]")).cast("double"))


def mulaw(x: Column) -> Column:
    """A value of [0, 1] as a whole number of [0, 255]; what isn't finite counts as 0."""
    x = _unit(x)
    return F.rint(255 * F.log(1 + 255 * x) / F.log(F.lit(256.0))).cast("int")


def inverse_mulaw(q: Column) -> Column:
    return (F.pow(F.lit(256.0), q / 255) - 1) / 255


def eight_bit(x: Column) -> Column:
    return F.rint(255 * _unit(x)).cast("int")


def random_crop(a: Column, length: int, seed: int, least: int | None = None) -> Column:
    """``length`` elements from a random place; a shorter array whole if it has ``least``."""
    n = F.size(a)
    start = F.floor(F.rand(seed) * (n - length + 1)).cast("int")
    whole = F.when(n >= (length if least is None else least), a).otherwise(F.raise_error(F.lit("too short to crop")).cast("array<double>"))
    return F.when(n >= length, F.slice(a, start + 1, F.lit(length))).otherwise(whole)


def mixed_halves(a: Column, length: int) -> Column:
    """The first and the second ``length`` elements added."""
    return F.zip_with(F.slice(a, 1, length), F.slice(a, length + 1, length), lambda x, y: x + y)


def trim_command(path: Column, intervals: Column, unit: str = "s", effect: str = "") -> Column:
    """A sox command that cuts the intervals (array of s, e) out of a file and joins them.

    Numbers or texts of numbers, written as they are; they have to rise, and there has to be one.
    unit: ``s`` for samples, nothing for seconds. effect: what follows the places, as ``norm -0.1``.
    """
    numbers = F.flatten(F.transform(intervals, lambda x: F.array(*[x[c].cast("decimal(38,7)") for c in "se"])))
    places = F.flatten(F.transform(intervals, lambda x: F.array(*[F.concat(F.lit("="), x[c].cast("string"), F.lit(unit)) for c in "se"])))
    rising = (F.size(numbers) > 0) & (numbers == F.array_sort(numbers))
    command = F.concat_ws(" ", F.lit("sox -t wav"), path, F.lit("-t wav - trim"), F.array_join(places, " "), *([F.lit(effect)] if effect else []), F.lit("|"))
    return F.when(rising, command).otherwise(F.raise_error(F.lit("intervals are not sorted, or there is none")).cast("string"))
