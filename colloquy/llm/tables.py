"""Reading the inputs and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows that go to a Python worker at once while a table is written: whole texts are long.
BATCH_ROWS = 1024
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go when the query that made them has ended, not when the driver's heap is full.
_END_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_left: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where the session names none and runs in one process, a folder beside its warehouse; on a
    cluster there is no such folder to guess.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/colloquy-checkpoints"


@contextmanager
def _while_writing(spark: SparkSession) -> Iterator[None]:
    """Shorter Arrow batches, and no shuffle files afterwards, for what runs inside."""
    before = {k: spark.conf.get(k) for k in (_BATCH_ROWS, _END_SHUFFLES)}
    rows = int(before[_BATCH_ROWS])
    spark.conf.set(_BATCH_ROWS, min(BATCH_ROWS, rows) if rows > 0 else BATCH_ROWS)
    spark.conf.set(_END_SHUFFLES, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Lineage ends at files that outlive executors, so a lost executor costs a re-read only.
    """
    path = f"{shared_dir(df.sparkSession)}/colloquy-{uuid.uuid4().hex}"
    _left.add(path)
    with _while_writing(df.sparkSession):
        df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._colloquy_path = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    _left.discard(path)


def discard(df: DataFrame) -> None:
    """Delete what written() wrote for ``df``; the caller no longer reads it."""
    _delete(df.sparkSession, df._colloquy_path)


def clear(spark: SparkSession) -> None:
    """Delete all written tables that are left; no result that reads them is needed any more."""
    for path in sorted(_left):
        _delete(spark, path)
