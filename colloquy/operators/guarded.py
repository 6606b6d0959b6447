"""Functions that may refuse a row: the refusal becomes a value, and refused rows a table of their own."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stages import exists


class Rejected(Exception):
    """Raised by a function to leave a row out; its text is the reason."""


def guarded(function: Callable[..., Any], schema: str, *inputs: str, caught: tuple[type[Exception], ...] = (Rejected,)) -> Column:
    """``value`` of the type ``schema``, and ``reason``, null where the function returned.

    A Rejected gives its own text, other caught exceptions their name before it. Exceptions that aren't
    caught end the job. Nulls reach the function as None; a value may be null without a reason.
    """

    @F.udf(returnType=f"struct<value: {schema}, reason: string>", useArrow=True)
    def run(*values: Any) -> tuple:
        try:
            return function(*values), None
        except caught as error:
            return None, str(error) if type(error) is Rejected else f"{type(error).__name__}: {error}"

    return run(*inputs)


def quarantined(rows: DataFrame, result: Column, path: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """The rows with their value, and the refused rows with their reason; together they are the input.

    Both are written by one job, so that the function runs once a row, to a folder for each, of which a
    reader lists only its own. A finished ``path`` is read as it is; a half one raises.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("_r", result)
    marked = marked.select(*rows.columns, F.col("_r.value").alias(value), F.col("_r.reason").alias("reason"), F.col("_r.reason").isNull().cast("int").alias("_kept"))
    if not exists(spark, path):
        marked.write.partitionBy("_kept").parquet(path)
    elif not exists(spark, f"{path}/_SUCCESS"):
        raise FileExistsError(f"{path} is there, but wasn't finished")
    back = spark.read.schema(marked.schema).parquet(path)
    return back.where("_kept = 1").select(*rows.columns, value), back.where("_kept = 0").select(*rows.columns, "reason")
