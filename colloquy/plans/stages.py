"""Stages that write a table once, and a registry of models that map files to text."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import publishing


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built only if it isn't there; half a table is an error."""
    if exists(spark, path):
        if not exists(spark, f"{path}/_SUCCESS"):
            raise FileExistsError(f"{path} is there, but wasn't finished")
    else:
        build().write.parquet(path)
    return spark.read.parquet(path)


def cached(inputs: list[DataFrame], root: str, build: Callable[[], DataFrame], **parameters: object) -> DataFrame:
    """The result of ``build`` for these inputs and parameters, stored in ``root`` by what they hold.

    Found again only for equal rows, columns, types and parameters; give the columns that the result depends
    on, since the inputs are read for the key. A JSON copy to look at lies beside the exact table. Of two
    builders of one key the first to end counts.
    """
    spark = inputs[0].sparkSession
    held = json.dumps([[publishing.digest(x) for x in inputs], parameters], sort_keys=True, default=str)
    path = f"{root}/{hashlib.sha256(held.encode()).hexdigest()[:32]}"
    if not exists(spark, path):
        fresh = f"{path}-{uuid.uuid4().hex}"
        build().write.parquet(fresh)
        try:
            publishing.rename(spark, fresh, path)
        except FileExistsError:
            pass
        else:
            spark.read.parquet(path).write.json(f"{path}.json")
    return spark.read.parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir; without one, beside the warehouse of a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or spark.conf.get('spark.sql.warehouse.dir')}/colloquy-{uuid.uuid4().hex}"


def selected(stages: list[str], wanted: str) -> list[str]:
    """``all``, names or numbers with commas, or ranges ``a-b``, in the order of the stages."""
    if wanted == "all":
        return list(stages)
    place = lambda x: int(x) if x.isdigit() else stages.index(x)
    chosen: set[int] = set()
    for part in wanted.split(","):
        low, dash, high = part.partition("-")
        chosen |= set(range(place(low), place(high) + 1)) if dash else {place(part)}
    return [s for i, s in enumerate(stages) if i in chosen]


#: A model is made once a worker and maps a list of paths to texts.
MODELS: dict[str, Callable[[], Callable[[list[str]], list[str]]]] = {}


def register(alias: str, make: Callable[[], Callable[[list[str]], list[str]]]) -> None:
    MODELS[alias] = make


def transcribed(files: DataFrame, path: str, model: str, words: str = "words", unreadable: tuple[type[Exception], ...] = ()) -> DataFrame:
    """``path, words``: the registered model over distinct files; what it can't read is ''.

    It can't read what gives None or raises one of ``unreadable``; then each file of the batch is tried alone.
    """
    make = MODELS[model]

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        text = make()

        def alone(file: str) -> str | None:
            try:
                return text([file])[0]
            except unreadable:
                return None

        for paths in batches:
            try:
                found = text(list(paths))
            except unreadable:
                found = [alone(file) for file in paths]
            yield pd.Series([x or "" for x in found], dtype=object)

    return files.select(path, run(path).alias(words))


def stub() -> Callable[[list[str]], list[str]]:
    """A model for tests: says which file it was given."""
    return lambda paths: [f"text of {p}" for p in paths]


register("stub", stub)
