"""What the queries over the driver's tables share: events as utterances of day-long sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session, speaker, user_id, s, e``: an event lasts as many seconds as its value says."""
    start = micros(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        F.col("ts").cast("date").cast("string").alias("session"),
        F.col("event_type").alias("speaker"),
        "user_id",
        start.alias("s"),
        (start + F.round(F.abs("value") * 1_000_000).cast("bigint") + 1).alias("e"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``speaker, frame, p``: events of each type in each hour, hours without any included."""
    counts = utterances(spark, sf_dir).groupBy("speaker", F.floor(F.col("s") / 3_600_000_000).alias("frame")).agg(F.count(F.lit(1)).alias("p"))
    spread = counts.groupBy("speaker").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    grid = spread.select("speaker", F.explode(F.sequence("a", "b")).alias("frame"))
    return grid.join(counts, ["speaker", "frame"], "left").select("speaker", "frame", F.coalesce("p", F.lit(0)).alias("p"))


UTTERANCES = """u AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_type AS speaker, user_id, epoch_us(ts) AS s,
  epoch_us(ts) + CAST(round(abs(value) * 1000000) AS BIGINT) + 1 AS e FROM events)"""
HOURLY = f"""{UTTERANCES},
counts AS (SELECT speaker, CAST(floor(s / 3600000000) AS BIGINT) AS frame, count(*) AS p FROM u GROUP BY ALL),
spread AS (SELECT speaker, min(frame) AS a, max(frame) AS b FROM counts GROUP BY speaker),
grid AS (SELECT speaker, unnest(generate_series(a, b)) AS frame FROM spread),
hourly AS (SELECT speaker, frame, coalesce(p, 0)::BIGINT AS p FROM grid LEFT JOIN counts USING (speaker, frame))"""


def union_sql(source: str, keys: str, name: str) -> str:
    """Common table expressions that end in ``name``, the union of the spans of ``source``."""
    return f"""{name}_a AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {source}),
{name}_b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {name}_a),
{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM {name}_b GROUP BY {keys}, run)"""


def depth_sql(source: str, keys: str, name: str, extra: str = "0") -> str:
    """Expressions that end in ``name``: elementary segments with ``depth`` and a weight ``who``."""
    return f"""{name}_a AS (SELECT {keys}, s AS t, 1 AS d, {extra} AS w FROM {source} UNION ALL SELECT {keys}, e, -1, -({extra}) FROM {source}),
{name}_b AS (SELECT {keys}, t, sum(d) AS d, sum(w) AS w FROM {name}_a GROUP BY {keys}, t),
{name} AS (SELECT * FROM (SELECT {keys}, t AS s, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS e, sum(d) OVER (PARTITION BY {keys} ORDER BY t) AS depth, sum(w) OVER (PARTITION BY {keys} ORDER BY t) AS who FROM {name}_b) WHERE depth > 0 AND e IS NOT NULL)"""
