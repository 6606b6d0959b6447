"""JSON sources: databases of nested examples, segment lists, simulation logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SEGLST


def database(spark: SparkSession, path: str | list[str], example: str, datasets: list[str] | None = None, *, lines: bool = False) -> DataFrame:
    """``dataset, example_id, example`` of ``{"datasets": {name: {id: example}}}`` documents.

    example: the examples' type as DDL. datasets: only these, in a filter before the explode. A file is one
    document and so one task; with ``lines`` each line is one (sinks.database_lines()), and files are split.
    """
    docs = spark.read.schema(f"datasets MAP<STRING, MAP<STRING, {example}>>").json(path, multiLine=not lines)
    names = docs.select(F.explode("datasets").alias("dataset", "_e"))
    names = names.where(F.col("dataset").isin(datasets)) if datasets else names
    return names.select("dataset", F.explode("_e").alias("example_id", "example"))


def seglst(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Segment lists with exact decimal times, quoted or not; other names of columns are mapped."""
    rows = spark.read.schema(SEGLST + ", file STRING, stop_sample BIGINT").json(path, multiLine=True)
    rows = rows.withColumns({"audio_path": F.coalesce("audio_path", "file"), "end_sample": F.coalesce("end_sample", "stop_sample")})
    return rows.drop("file", "stop_sample")


def mix_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each mixture of a simulation log. The log's t60 is the decay time."""
    return spark.read.schema("output STRING, inputs ARRAY<STRUCT<speaker_id: STRING, path: STRING, offset_in_samples: BIGINT>>, speakers ARRAY<STRING>, t60 DOUBLE, snr DOUBLE").json(path, multiLine=True).withColumnRenamed("t60", "sound_decay_time")


def with_paths(value, **folders: str):
    """Texts like ``{egs}/train.json`` with the folders' paths, also inside lists and dicts."""
    if isinstance(value, str):
        return value.format(**folders)
    if isinstance(value, dict):
        return {k: with_paths(v, **folders) for k, v in value.items()}
    return [with_paths(v, **folders) for v in value] if isinstance(value, (list, tuple)) else value


def selected(spark: SparkSession, configs: dict[str, dict], names: list[str], example: str, **folders: str) -> DataFrame:
    """The examples of the named configurations (``path``, maybe ``datasets`` and ``lines``); others aren't read."""
    wanted = [with_paths(configs[n], **folders) for n in names]
    return union([database(spark, c["path"], example, c.get("datasets"), lines=c.get("lines", False)) for c in wanted])


def routed(tables: dict[str, DataFrame], variant: str, datasets: list[str] | None = None) -> DataFrame:
    """The table of the exact name, else of the only name that is in ``variant`` or, as a pattern, found in it.

    Several such names, or none, are an error. datasets: only the rows of these.
    """
    found = [variant] if variant in tables else [k for k in tables if k in variant or re.search(k, variant)]
    if len(found) != 1:
        raise KeyError(f"{variant!r} matches {found or 'no table'}")
    rows = tables[found[0]]
    return rows.where(F.col("dataset").isin(datasets)) if datasets is not None else rows


def union(parts: list[DataFrame]) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    first, *rest = [p.select("*") for p in parts]
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def enough_speakers(examples: DataFrame, speakers: Column, n: int) -> DataFrame:
    return examples.where(F.size(F.array_distinct(speakers)) == n)
