"""Line-oriented sources: key-value lists, segments, alignments, RTTM, STM, TSV."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.joins import renamed_ids

#: The dataset in the paths of lists that a sink wrote with a folder for each dataset.
DATASET = r"/dataset=([^/]+)/[^/]+$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, with their file and place: file, block and number, in that order.

    A number rises inside a block; files and blocks are read in any order.
    """
    meta = F.col("_metadata")
    place = F.struct(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line_no"))
    return spark.read.text(path).select(F.trim("value").alias("line"), meta["file_path"].alias("file"), place.alias("place")).where("line <> ''")


def path_part(path: Column, pattern: str) -> Column:
    """What the pattern's one group finds in a path; a path that it doesn't match raises."""
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1)).otherwise(F.raise_error(F.concat(F.lit("no name in this path: "), path)).cast("string"))


def key_value(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """``key, value``: cut at the first white space, '' for no value; the last of equal keys, files by name.

    dataset: a pattern with one group, for paths that stand for many files; ``dataset`` is what it finds in a
    file's path, and keys are equal only inside one.
    """
    parts = F.split("line", r"\s+", 2)
    keys = [F.get(parts, 0).alias("key")] + ([path_part(F.col("file"), dataset).alias("dataset")] if dataset else [])
    rows = _lines(spark, path).select(*keys, F.coalesce(F.get(parts, 1), F.lit("")).alias("value"), "place")
    return rows.groupBy(*[c for c in ("dataset", "key") if c in rows.columns]).agg(F.max_by("value", "place").alias("value"))


def durations(spark: SparkSession, path: str) -> DataFrame:
    return key_value(spark, path).withColumn("value", F.col("value").cast("double"))


def lists(spark: SparkSession, path: str) -> DataFrame:
    """``key, values``: the words after each key."""
    return key_value(spark, path).select("key", F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("values"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """``utterance, recording, start, end``, times as they are written; four columns exactly."""
    parts = F.split("line", r"\s+")
    ok = F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.concat(F.lit("four columns are needed: "), F.col("line"))).cast("array<string>"))
    rows = _lines(spark, path).select(ok.alias("p"))
    return rows.select(*[F.get("p", i).alias(n) for i, n in enumerate(["utterance", "recording", "start", "end"])])


def per_utterance(spark: SparkSession, path: str) -> DataFrame:
    """``utterance, ref, hyp, op, csid``: lines of an utterance, a tag and the rest."""
    parts = F.split("line", r"\s+", 3)
    tag = F.get(parts, 1)
    known = F.when(tag.isin("ref", "hyp", "op", "#csid"), tag).otherwise(F.raise_error(F.concat(F.lit("unknown tag: "), tag)))
    rows = _lines(spark, path).select(F.get(parts, 0).alias("utterance"), known.alias("tag"), F.coalesce(F.get(parts, 2), F.lit("")).alias("rest"))
    wide = rows.groupBy("utterance").pivot("tag", ["ref", "hyp", "op", "#csid"]).agg(F.first("rest"))
    squash = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ").alias(c)
    return wide.select("utterance", *map(squash, ["ref", "hyp", "op"]), F.split(F.trim(F.col("#csid")), r"\s+").cast("array<int>").alias("csid"))


READERS = {"wav.scp": key_value, "text": key_value, "utt2spk": key_value, "utt2dur": durations, "spk2utt": lists, "segments": segments, "per_utt": per_utterance}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The reader that the file's name stands for; ``text_hyp_`` and any model's name is a text."""
    name = path.rstrip("/").rpartition("/")[2]
    known = "text" if name.startswith("text_hyp_") else name
    if known not in READERS:
        raise ValueError(f"no reader for {name!r}; there are {sorted(READERS)}")
    return READERS[known](spark, path)


def rttm(spark: SparkSession, path: str | list[str], name: Callable[[Column], Column] | None = None) -> DataFrame:
    """``session_id, speaker, start_time, duration`` of the SPEAKER lines of one file or many.

    name: makes other ids of the files' ids; raises where there is none or where two sessions would become one.
    """
    p = F.split("line", r"\s+")
    rows = _lines(spark, path).where(F.col("line").startswith("SPEAKER"))
    rows = rows.select(F.get(p, 1).alias("session_id"), F.get(p, 7).alias("speaker"), F.get(p, 3).cast("decimal(18,7)").alias("start_time"), F.get(p, 4).cast("decimal(18,7)").alias("duration"))
    return renamed_ids(rows, "session_id", name(F.col("session_id"))) if name else rows


def stm(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``session_id, channel, speaker, start_time, end_time, words``; ``;`` begins a comment."""
    p = F.split("line", r"\s+", 6)
    rows = _lines(spark, path).where(~F.col("line").startswith(";"))
    time = lambda i, n: F.get(p, i).cast("decimal(18,7)").alias(n)
    return rows.select(F.get(p, 0).alias("session_id"), F.get(p, 1).alias("channel"), F.get(p, 2).alias("speaker"), time(3, "start_time"), time(4, "end_time"), F.coalesce(F.get(p, 5), F.lit("")).alias("words"))


def normalised(rows: DataFrame) -> DataFrame:
    """stm() rows with cleaned words, '' where none are left, and without the channel in the session's name."""
    return rows.withColumns({"words": F.coalesce(text.cleaned(F.col("words")), F.lit("")), "session_id": F.replace("session_id", F.lit("_CH0_"), F.lit("_"))})


def meeting_info(spark: SparkSession, path: str, meeting: str = r"([^/]+)/transcription/[^/]+$") -> DataFrame:
    """Tab-separated utterances with a header; a quote inside quotes is written twice.

    meeting: what finds the meeting's name in a file's path, by default the folder two above the file.
    """
    schema = "start_time DECIMAL(18,7), end_time DECIMAL(18,7), speaker STRING, utterance_id STRING, transcription STRING"
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', schema=schema, enforceSchema=False)
    return rows.withColumn("meeting", path_part(F.col("_metadata.file_path"), meeting))
