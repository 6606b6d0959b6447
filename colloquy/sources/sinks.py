"""Text and JSON sinks. Sorted lists are part files that follow each other by name."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import publishing


def key_value(rows: DataFrame, path: str, key: str = "key", value: str = "value", dataset: str | None = None) -> None:
    """``key value`` lines sorted by key, in as many parts as the ranges of keys need.

    dataset: a column; each of its values gets a folder ``dataset=...`` of its own, sorted the same way.
    """
    line = F.concat_ws(" ", key, value).alias("line")
    if dataset:
        rows.orderBy(dataset, key).select(line, F.col(dataset).alias("dataset")).write.partitionBy("dataset").text(path)
    else:
        rows.orderBy(key).select(line).write.text(path)


def hypotheses(rows: DataFrame, folder: str, model: str, key: str = "key", words: str = "words") -> str:
    """The words that a model found, as ``key words`` lines without an order; the path, which names the model."""
    path = f"{folder}/text_hyp_{model}"
    rows.select(F.concat_ws(" ", key, words).alias("line")).write.text(path)
    return path


def lists(rows: DataFrame, path: str, key: str = "key", values: str = "values") -> None:
    """``key value value ...`` lines sorted by key."""
    key_value(rows.withColumn(values, F.array_join(values, " ")), path, key, values)


def segments(rows: DataFrame, path: str) -> None:
    key_value(rows.select(F.col("utterance").alias("key"), F.concat_ws(" ", "recording", "start", "end").alias("value")), path)


def speaker_lists(utt2spk: DataFrame) -> DataFrame:
    """``key, values``: the sorted utterances of each speaker."""
    return utt2spk.groupBy(F.col("value").alias("key")).agg(F.array_sort(F.collect_list("key")).alias("values"))


def utterance_folder(utterances: DataFrame, recordings: DataFrame, path: str) -> None:
    """A folder of ``segments, utt2spk, spk2utt, text, wav.scp``, each a sorted list, from one job.

    utterances: ``utterance, recording, start, end, speaker, words``; recordings: ``key, value``. Null words have
    no line in ``text``, and a list without lines isn't written; any other null raises, and so does an utterance
    given twice. ``path`` appears as a whole, and must not be there before. The format has one line for a
    speaker, so that a speaker's names are one row.
    """
    spark = utterances.sparkSession
    names = ["utterance", "recording", "start", "end", "speaker"]
    known = F.when(F.expr(" AND ".join(f"`{n}` IS NOT NULL" for n in names)), F.col("utterance")).otherwise(F.raise_error(F.lit("an utterance lacks a field")))
    once = utterances.groupBy("utterance").agg(*[F.min(c).alias(c) for c in [*names[1:], "words"]], F.count(F.lit(1)).alias("_n"))
    once = once.withColumn("utterance", F.when(F.col("_n") == 1, known).otherwise(F.raise_error(F.concat(F.lit("twice: "), "utterance"))))
    entry = lambda file, value: F.struct(F.lit(file).alias("file"), F.col("utterance").alias("key"), value.alias("value"))
    entries = F.array(entry("segments", F.concat_ws(" ", "recording", "start", "end")), entry("utt2spk", F.col("speaker")), entry("text", F.col("words")))
    lines = once.select(F.inline(entries)).where("value IS NOT NULL")
    speakers = speaker_lists(once.select(F.col("utterance").alias("key"), F.col("speaker").alias("value")))
    lines = lines.unionByName(speakers.select(F.lit("spk2utt").alias("file"), "key", F.array_join("values", " ").alias("value")))
    lines = lines.unionByName(recordings.select(F.lit("wav.scp").alias("file"), "key", "value"))
    fresh = f"{path}-{uuid.uuid4().hex}"
    lines.orderBy("file", "key").select(F.concat_ws(" ", "key", "value").alias("line"), "file").write.partitionBy("file").text(fresh)
    for name in publishing.names(spark, fresh):
        if name.startswith("file="):
            publishing.rename(spark, f"{fresh}/{name}", f"{fresh}/{name.removeprefix('file=')}")
    publishing.rename(spark, fresh, path)


def seglst(rows: DataFrame, path: str) -> None:
    """One JSON list of segments, or of any other rows, in each part file; decimal columns keep all their digits."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening = "["
        for batch in batches:
            for line in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([opening + line])], names=["value"])
                opening = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if opening == "," else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).mapInArrow(listed, "value string").write.text(path)


def database(rows: DataFrame, path: str) -> None:
    """Examples as Parquet, a folder for each dataset, which a selection of datasets prunes."""
    rows.write.partitionBy("dataset").parquet(path)


def database_lines(rows: DataFrame, path: str) -> None:
    """``dataset, example_id, example`` as JSON, a line for each example that is a whole document by itself."""
    held = F.create_map("dataset", F.create_map("example_id", "example"))
    rows.select(F.to_json(F.struct(held.alias("datasets"))).alias("line")).write.text(path)


def rttm(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """SPEAKER lines; an existing target stays unless it's to be overwritten."""
    line = F.concat_ws(" ", F.lit("SPEAKER"), "session_id", F.lit("1"), F.col("start_time").cast("string"), F.col("duration").cast("string"), F.lit("<NA> <NA>"), "speaker", F.lit("<NA> <NA>"))
    rows.orderBy("session_id", "start_time", "speaker").select(line.alias("line")).write.mode("overwrite" if overwrite else "ignore").text(path)


def stm(rows: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "session_id", "channel", "speaker", F.col("start_time").cast("string"), F.col("end_time").cast("string"), "words")
    rows.orderBy("session_id", "start_time", "speaker").select(line.alias("line")).write.text(path)
