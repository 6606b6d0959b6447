"""Queries of scores under the best assignment of speakers, of splits and word errors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diarisation
from .common import UTTERANCES, table, union_sql, utterances

COLLAR, SLICE = 250_000, 600_000_000


def diarization_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's events against themselves, later, shorter and partly under another name."""
    u = utterances(spark, sf_dir)
    other = F.when(F.col("user_id") % 4 == 0, F.lit("guest")).otherwise(F.reverse("speaker"))
    heard = u.select("session", other.alias("speaker"), (F.col("s") + 40_000).alias("s"), (F.col("e") - 70_000).alias("e")).where("s < e")
    rows = diarisation.error_times(u.select("session", "speaker", "s", "e"), heard, ["session"], "speaker", collar=COLLAR, width=SLICE)
    return rows.withColumn("der", F.round("der", 9))


def concatenated_word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself without the letter e, its turns dealt to three speakers."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")
    place = F.concat(F.lit("s"), (F.floor(F.col("turn") * 2 / 3) % 3).cast("string"))
    heard = turns.select("conv_id", "turn", place.alias("speaker"), F.regexp_replace("text", "e", "").alias("text"))
    rows = diarisation.word_errors_of_sessions(turns, heard, ["conv_id"], "speaker", ["turn"], "text")
    return rows.withColumn("error_rate", F.round("error_rate", 9))


QUERIES = {f.__name__: f for f in (diarization_error_rate, concatenated_word_error_rate)}


def edit_sql(pairs: str) -> str:
    """Expressions that end in ``edits(id, errors, n)``, from ``pairs(id, x, y)``, two lists of words.

    A row of the table of edit distances for each word of x; the least over the places before is a window.
    """
    return f"""wy AS MATERIALIZED (SELECT id, j, y[j] AS w FROM {pairs}, LATERAL (SELECT unnest(generate_series(1, len(y))) AS j)),
wx AS MATERIALIZED (SELECT id, i, x[i] AS w FROM {pairs}, LATERAL (SELECT unnest(generate_series(1, len(x))) AS i)),
steps(id, i, j, d) AS (
  SELECT id, 0::BIGINT, unnest(generate_series(0, len(y))), unnest(generate_series(0, len(y))) FROM {pairs}
  UNION ALL
  SELECT id, i, j, (min(best - j) OVER (PARTITION BY id ORDER BY j) + j)::BIGINT FROM (
    SELECT s.id, s.i + 1 AS i, s.j, CASE WHEN s.j = 0 THEN s.i + 1 ELSE least(s.d + 1, lag(s.d) OVER (PARTITION BY s.id ORDER BY s.j) + CASE WHEN wx.w = wy.w THEN 0 ELSE 1 END) END AS best
    FROM steps s JOIN wx ON wx.id = s.id AND wx.i = s.i + 1 LEFT JOIN wy ON wy.id = s.id AND wy.j = s.j)),
edits AS (SELECT p.id, d AS errors, len(x) AS n FROM {pairs} p JOIN steps s ON s.id = p.id AND s.i = len(x) AND s.j = len(y))"""


_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
_ASSIGN = """picks(k, done, used, v) AS (
  SELECT k, 0::BIGINT, []::VARCHAR[], 0::BIGINT FROM lefts
  UNION ALL
  SELECT p.k, p.done + 1, CASE WHEN o.b IS NULL THEN p.used ELSE p.used || [o.b] END, p.v + o.v
  FROM picks p JOIN options o ON o.k = p.k AND o.place = p.done + 1 WHERE o.b IS NULL OR NOT list_contains(p.used, o.b)),
best AS (SELECT k, min(v) AS v FROM picks JOIN (SELECT k AS k, n FROM lefts) l USING (k) WHERE done = n GROUP BY k)"""

ORACLE_SQL = {
    "diarization_error_rate": f"""
WITH RECURSIVE {UTTERANCES},
heard AS (SELECT session, CASE WHEN user_id % 4 = 0 THEN 'guest' ELSE reverse(speaker) END AS speaker, s + 40000 AS s, e - 70000 AS e FROM u WHERE s + 40000 < e - 70000),
{union_sql("u", "session, speaker", "ref")}, {union_sql("heard", "session, speaker", "hyp")},
around AS (SELECT session, s - {COLLAR // 2} AS s, s + {COLLAR // 2} AS e FROM ref UNION ALL SELECT session, e - {COLLAR // 2}, e + {COLLAR // 2} FROM ref),
{union_sql("around", "session", "outside")},
edges AS (SELECT session, unnest([s, e]) AS t FROM (SELECT session, s, e FROM ref UNION ALL SELECT session, s, e FROM hyp UNION ALL SELECT * FROM outside)),
parts AS MATERIALIZED (
  SELECT p.* FROM (SELECT session, t AS s, lead(t) OVER (PARTITION BY session ORDER BY t) AS e FROM (SELECT DISTINCT * FROM edges)) p
  LEFT JOIN outside o ON o.session = p.session AND o.s <= p.s AND p.e <= o.e WHERE p.e IS NOT NULL AND o.s IS NULL),
a AS MATERIALIZED (SELECT p.*, r.speaker AS a FROM parts p JOIN ref r ON r.session = p.session AND r.s <= p.s AND p.e <= r.e),
b AS MATERIALIZED (SELECT p.*, r.speaker AS b FROM parts p JOIN hyp r ON r.session = p.session AND r.s <= p.s AND p.e <= r.e),
counts AS (
  SELECT session, e - s AS t, coalesce(n, 0) AS n, coalesce(m, 0) AS m
  FROM (SELECT session, s, e, count(*) AS n FROM a GROUP BY ALL) FULL JOIN (SELECT session, s, e, count(*) AS m FROM b GROUP BY ALL) USING (session, s, e)),
sums AS (SELECT session, sum(t * n) AS total, sum(t * greatest(n - m, 0)) AS missed, sum(t * greatest(m - n, 0)) AS false_alarm, sum(t * least(n, m)) AS shared FROM counts GROUP BY session),
places AS (SELECT session AS k, a, row_number() OVER (PARTITION BY session ORDER BY a) AS place FROM (SELECT DISTINCT session, a FROM a)),
lefts AS MATERIALIZED (SELECT k, count(*) AS n FROM places GROUP BY k),
options AS MATERIALIZED (
  SELECT k, place, b, -sum(e - s)::BIGINT AS v FROM (SELECT a.session AS k, a.a, b.b, a.s, a.e FROM a JOIN b USING (session, s, e)) JOIN places USING (k, a) GROUP BY k, place, b
  UNION ALL SELECT k, place, NULL, 0 FROM places),
{_ASSIGN}
SELECT session, total::BIGINT AS total, missed::BIGINT AS missed, false_alarm::BIGINT AS false_alarm, (shared + coalesce(v, 0))::BIGINT AS confusion,
  round((missed + false_alarm + shared + coalesce(v, 0))::DOUBLE / nullif(total, 0), 9) AS der FROM sums LEFT JOIN best ON best.k = session""",
    "concatenated_word_error_rate": f"""
WITH RECURSIVE r AS (SELECT conv_id, role AS a, string_agg(coalesce(text, ''), ' ' ORDER BY turn) AS t FROM conversations GROUP BY conv_id, role),
h AS (SELECT conv_id, 's' || (floor(turn * 2 / 3)::BIGINT % 3) AS b, string_agg(replace(coalesce(text, ''), 'e', ''), ' ' ORDER BY turn) AS t FROM conversations GROUP BY ALL),
rw AS MATERIALIZED (SELECT conv_id, a, {_WORDS.format("t")} AS x, row_number() OVER (PARTITION BY conv_id ORDER BY a) AS place FROM r),
hw AS MATERIALIZED (SELECT conv_id, b, {_WORDS.format("t")} AS y FROM h),
pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, conv_id, place, b, x, y FROM rw JOIN hw USING (conv_id)),
{edit_sql("pairs")},
lefts AS MATERIALIZED (SELECT conv_id AS k, count(*) AS n, sum(len(x)) AS length FROM rw GROUP BY conv_id),
heard AS (SELECT conv_id AS k, sum(len(y)) AS m FROM hw GROUP BY conv_id),
options AS MATERIALIZED (
  SELECT conv_id AS k, place, b, errors - len(y) AS v FROM pairs JOIN edits USING (id) UNION ALL SELECT conv_id, place, NULL, len(x) FROM rw),
{_ASSIGN}
SELECT k AS conv_id, (v + m)::BIGINT AS errors, length::BIGINT AS length, round((v + m)::DOUBLE / nullif(length, 0), 9) AS error_rate FROM best JOIN heard USING (k) JOIN lefts USING (k)""",
    "word_error_counts": f"""
WITH RECURSIVE pairs AS MATERIALIZED (SELECT row_number() OVER () AS id, role, {_WORDS.format("coalesce(text, '')")} AS x, {_WORDS.format("replace(coalesce(text, ''), 'e', '')")} AS y FROM conversations),
{edit_sql("pairs")}
SELECT role, sum(errors)::BIGINT AS errors, sum(n)::BIGINT AS length FROM pairs JOIN edits USING (id) GROUP BY role""",
}
