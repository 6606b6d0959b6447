"""Folders that change as a whole: written beside their place and renamed into it.

A rename is one step on HDFS and on local disks; on an object store it's a copy, and readers need a
table format there.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How the folder of a version is called: its number after this.
VERSION = "version-"


def _path(spark: SparkSession, name: str) -> tuple[JavaObject, JavaObject]:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Move a file or folder to a name that isn't taken; FileExistsError if it is."""
    (old, files), (new, _) = _path(spark, source), _path(spark, target)
    options = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    if files.exists(new):
        raise FileExistsError(target)
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(old), files.makeQualified(new), options)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, without its path; nothing if it isn't there."""
    path, files = _path(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(path)) if files.exists(path) else []


def digest(rows: DataFrame) -> tuple:
    """Number of rows and two sums of hashes: equal for equal rows in any order, repeats counted."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"})
    sums = [F.sum(h.cast("decimal(20,0)")) for h in (F.xxhash64(row), F.xxhash64(row, F.lit("again")))]
    return (*sorted((f.name, f.dataType.simpleString()) for f in rows.schema), *rows.agg(F.count(F.lit(1)), *sums).first())


def write_if_changed(rows: DataFrame, path: str, backups: str | None = None, now: datetime | None = None) -> str | None:
    """Write Parquet to ``path`` unless the same rows are there already; None if nothing was touched.

    What was there is kept as ``<name>_<date and time>`` in ``backups`` (beside it, if not given), whose name is
    returned, or '' if there was nothing. ``rows`` may read ``path``. A folder that isn't a finished table raises.
    """
    spark = rows.sparkSession
    (target, files), old = _path(spark, path), ""
    if files.exists(target):
        if not files.exists(_path(spark, f"{path}/_SUCCESS")[0]):
            raise FileExistsError(f"{path} is there and isn't a finished table")
        if digest(spark.read.parquet(path)) == digest(rows):
            return None
        old = f"{backups or target.getParent().toString()}/{target.getName()}_{(now or datetime.now()):%Y_%m_%d_%H_%M_%S}"
    fresh = f"{target.getParent().toString()}/.{target.getName()}-{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    if old:
        files.mkdirs(_path(spark, old)[0].getParent())
        rename(spark, path, old)
    rename(spark, fresh, path)
    return old


def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of the published versions, rising; FileExistsError if anything else is in the folder."""
    found = names(spark, root)
    foreign = [n for n in found if not re.fullmatch(rf"\.?{VERSION}.*", n)]
    if foreign:
        raise FileExistsError(f"{root} holds what wasn't published: {sorted(foreign)[:3]}")
    return sorted(int(n.removeprefix(VERSION)) for n in found if n[0] != ".")


def publish(rows: DataFrame, root: str) -> int:
    """Write a new version and make it the one that readers find, in one step; its number.

    Of two writers that take one number the second gets FileExistsError, and its rows aren't seen.
    """
    spark = rows.sparkSession
    number = max(versions(spark, root), default=0) + 1
    fresh = f"{root}/.{VERSION}{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    rename(spark, fresh, f"{root}/{VERSION}{number:08d}")
    return number


def published(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version; readers that have begun with an older one aren't disturbed."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/{VERSION}{found[-1]:08d}")


def retire(spark: SparkSession, root: str, keep: int) -> None:
    """Delete all versions but the newest ``keep``, which is at least 1."""
    for number in versions(spark, root)[: -max(keep, 1)]:
        path, files = _path(spark, f"{root}/{VERSION}{number:08d}")
        files.delete(path, True)
