"""Paths of recordings: commands that cut spans out of a file, channels behind ``::``, edits of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What vectors.trim_command() writes: the file, the places and an effect after them.
COMMAND = r"^sox -t wav (.+) -t wav - trim((?: =[0-9]+(?:\.[0-9]+)?s?)+)(?: ([^= ].*?))? \|$"
#: A file name behind its folders: stem and suffix, which a name that begins with its only dot lacks.
NAME = r"^(.*/)?([^/]+?)(\.[^./]+)?$"
#: The slice that stands for one channel.
CHANNEL = r"^\[:,([0-9]+):([0-9]+)\]$"


def parsed(value: Column) -> Column:
    """``path, unit, intervals (s, e), effect`` of a plain path (no intervals, null unit) or of a command.

    Numbers stay as they are written; the unit is ``s`` for samples and nothing for seconds. Another command,
    one with an odd number of places or with both units raises; null stays null.
    """
    places = F.regexp_extract_all(F.regexp_extract(value, COMMAND, 2), F.lit(r"=([0-9.]+)s?"), F.lit(1))
    units = F.array_distinct(F.regexp_extract_all(F.regexp_extract(value, COMMAND, 2), F.lit(r"=[0-9.]+(s?)"), F.lit(1)))
    intervals = F.transform(F.sequence(F.lit(0), F.size(places) - 2, F.lit(2)), lambda i: F.struct(F.get(places, i).alias("s"), F.get(places, i + 1).alias("e")))
    fields = lambda path, unit, spans, effect: F.struct(path.alias("path"), unit.alias("unit"), spans.alias("intervals"), effect.alias("effect"))
    none = F.lit(None).cast("string")
    plain = fields(value, none, F.array().cast("array<struct<s: string, e: string>>"), none)
    command = fields(F.regexp_extract(value, COMMAND, 1), F.get(units, 0), intervals, F.nullif(F.regexp_extract(value, COMMAND, 3), F.lit("")))
    well_formed = value.rlike(COMMAND) & (F.size(places) % 2 == 0) & (F.size(units) == 1)
    return F.when(value.isNull(), None).when(~value.rlike(r"\|\s*$"), plain).when(well_formed, command).otherwise(
        F.raise_error(F.concat(F.lit("not a command that can be read: "), value)).cast("struct<path: string, unit: string, intervals: array<struct<s: string, e: string>>, effect: string>")
    )


def with_channel(path: Column, channel: Column) -> Column:
    """The path with the slice of one channel behind it."""
    return F.concat(path, F.lit("::[:,"), channel.cast("string"), F.lit(":"), (channel + 1).cast("string"), F.lit("]"))


def channel_of(path: Column) -> Column:
    """``path, channel``: null where no slice follows; a slice of more than one channel raises."""
    cut = F.when(path.contains("::"), F.substring_index(path, "::", -1))
    low, high = (F.regexp_extract(cut, CHANNEL, i).cast("int") for i in (1, 2))
    one = F.when(cut.isNull(), F.lit(None).cast("int")).when(cut.rlike(CHANNEL) & F.coalesce(high == low + 1, F.lit(False)), low)
    channel = one.otherwise(F.raise_error(F.concat(F.lit("not one channel: "), path)).cast("int"))
    file = F.when(cut.isNull(), path).otherwise(F.substr(path, F.lit(1), F.length(path) - F.length(cut) - 2))
    return F.struct(file.alias("path"), channel.alias("channel"))


def with_stem_end(path: Column, end: str | Column) -> Column:
    """``end`` between the file name's stem and its last suffix."""
    end = F.lit(end) if isinstance(end, str) else end
    folder, stem, suffix = (F.regexp_extract(path, NAME, i) for i in (1, 2, 3))
    return F.when(path.rlike(NAME), F.concat(folder, stem, end, suffix)).otherwise(path)


def renamed(path: Column, old: str, new: str | Column) -> Column:
    """``old`` replaced by ``new`` in the file name, not in its folders."""
    folder = F.regexp_extract(path, r"^(.*/)?", 1)
    name = F.substr(path, F.length(folder) + 1)
    return F.concat(folder, F.replace(name, F.lit(old), F.lit(new) if isinstance(new, str) else new))
