"""Lookups in static tables and the joins of line-oriented tables; a miss is an error or stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import units, vectors
from ..schema import SAMPLE_RATE
from . import intervals


def required(value: Column, what: str) -> Column:
    """The value; null raises when the column is computed."""
    return F.when(value.isNull(), F.raise_error(F.lit(what))).otherwise(value)


def translated(rows: DataFrame, table: DataFrame, key: str, out: str, default: Column | None = None) -> DataFrame:
    """``out``: what a two-column table of names makes of ``key``; a name that is a result already stays.

    A name that the table lacks gets the default, else it raises; a null key counts as such a name.
    The table has one row a name; of several, the smallest result counts.
    """
    a, b = (F.col(c) for c in table.columns[:2])
    known = table.select(a.alias("_k"), b.alias("_t"), F.lit(0).alias("_r")).unionByName(table.select(b.alias("_k"), b.alias("_t"), F.lit(1).alias("_r")))
    known = known.groupBy("_k").agg(F.min(F.struct("_r", "_t"))["_t"].alias("_t"))
    joined = rows.join(known, F.col(key) == F.col("_k"), "left")
    value = required(F.col("_t"), f"unknown {key}") if default is None else F.coalesce("_t", default)
    return joined.withColumn(out, value).drop("_k", "_t")


def filled(rows: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` where a row has it, else the table's value of the key, else null.

    A key may stand in the table several times with one value; with two, a row that needs it raises.
    """
    known = table.groupBy(F.col(key).alias("_k")).agg(F.min(value).alias("_v"), F.max(value).alias("_w"))
    joined = rows.join(known, (F.col(key) == F.col("_k")) & F.col(value).isNull(), "left")
    two = F.raise_error(F.concat(F.lit("two values of "), F.col("_k").cast("string"))).cast(table.schema[value].dataType)
    found = F.when(F.col("_v") < F.col("_w"), two).otherwise(F.col("_v"))
    return joined.withColumn(value, F.coalesce(value, found)).drop("_k", "_v", "_w")


def place_in(values: Column, value: Column) -> Column:
    """Where a value first stands in an array, from 0; raises if it doesn't."""
    place = F.array_position(values, value)
    return F.when(place > 0, place - 1).otherwise(F.raise_error(F.lit("not in the list")))


def _with_speakers(segments: DataFrame, utt2spk: DataFrame) -> DataFrame:
    """Segments with their speaker; utterances of one table alone, or twice in one, raise."""
    once = segments.groupBy("utterance").agg(*[F.first(c).alias(c) for c in ("recording", "start", "end")], F.count(F.lit(1)).alias("_n"))
    speakers = utt2spk.groupBy(F.col("key").alias("_u")).agg(F.first("value").alias("speaker"), F.count(F.lit(1)).alias("_m"))
    both = once.join(speakers, F.col("utterance") == F.col("_u"), "full")
    single = (F.col("_n") == 1) & (F.col("_m") == 1)
    recording = F.when(single, F.col("recording")).otherwise(F.raise_error(F.concat(F.lit("not once in both tables: "), F.coalesce("utterance", "_u"))))
    return both.select("utterance", recording.alias("recording"), "speaker", "start", "end")


def speaker_recordings(segments: DataFrame, utt2spk: DataFrame, recordings: DataFrame) -> DataFrame:
    """``key, recording, speaker, value``: for each speaker of a recording, the command that cuts out its speech.

    segments: ``utterance, recording, start, end`` in seconds; the others: ``key, value``. A speaker whose name
    begins with the recording's is its own key, else both names are it. Segments go by start and may not
    overlap inside one speaker; a recording without a path raises.
    """
    rows = _with_speakers(segments, utt2spk)
    start = F.col("start").cast("decimal(18,7)")
    spans = F.transform(F.array_sort(F.collect_list(F.struct(start.alias("at"), F.col("end").alias("e"), F.col("start").alias("s")))), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    groups = rows.groupBy("recording", "speaker").agg(spans.alias("_spans"))
    paths = recordings.select(F.col("key").alias("_k"), F.col("value").alias("_path"))
    joined = groups.join(paths, F.col("recording") == F.col("_k"), "left")
    key = F.when(F.col("speaker").startswith(F.col("recording")), F.col("speaker")).otherwise(F.concat_ws("-", "recording", "speaker"))
    command = vectors.trim_command(required(F.col("_path"), "a recording without a path"), F.col("_spans"), "")
    return joined.select(key.alias("key"), "recording", "speaker", command.alias("value"))


def speaker_intervals(segments: DataFrame, utt2spk: DataFrame, rate: int = SAMPLE_RATE, within: int | None = None) -> DataFrame:
    """``recording, speaker, s, e``: the union of each speaker's segments in samples, cut off not rounded."""
    rows = _with_speakers(segments, utt2spk)
    spans = rows.select("recording", "speaker", units.samples_by_decimal(F.col("start"), rate).alias("s"), units.samples_by_decimal(F.col("end"), rate).alias("e"))
    return intervals.union(spans.where("s < e"), ["recording", "speaker"], within=within)
