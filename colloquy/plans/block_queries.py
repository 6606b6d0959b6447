"""Queries of blocks of frames, of table functions over segments and of guarded parsing, and their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, ids, text, vectors
from ..functions.units import rounded
from ..operators import blocks, estimates, guarded, joins, reshape, stats
from ..operators import intervals as iv
from ..operators.carried import numbered
from ..sources import sinks, texts
from . import stages
from .common import UTTERANCES, table, union_sql, utterances

MINUTE = 60_000_000
BLOCK = 64


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of a recording for each label, in order of their ids."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    return numbered(rows, ["label"], ["vec_id"], F.floor(F.col("vec_id") / 1000), "frame")


def framewise_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each vector the frames of an example of one to three seconds that begins where it stands."""
    tracks = _tracks(spark, sf_dir)
    start = F.col("frame") * 640
    begin, end = blocks.framewise_region(start, start + 16_000 * (1 + F.col("vec_id") % 3))
    examples = tracks.select("vec_id", "label", begin.alias("s"), end.alias("e"))
    cut = blocks.pieces(examples, blocks.blocked(tracks, ["label"], "frame", "embedding", BLOCK), ["label"], BLOCK)
    whole = blocks.stitched(cut, ["vec_id", "label", "s"])
    milli = lambda x: F.coalesce(F.floor(F.get(x, 0).cast("double") * 1000), F.lit(0)).cast("bigint")
    weighed = F.transform("values", lambda x, i: milli(x) * (i + 1))
    digest = F.aggregate(weighed, F.lit(0).cast("bigint"), lambda total, x: total + x)
    return whole.select("vec_id", "label", "s", F.size("values").cast("bigint").alias("n"), digest.alias("digest"))


def _minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session, speaker, s, e``: the union of the minutes of a day in which a speaker is active."""
    day = F.unix_micros(F.col("session").cast("timestamp"))
    rows = utterances(spark, sf_dir).withColumns({"s": F.floor((F.col("s") - day) / MINUTE), "e": F.floor((F.col("e") - 1 - day) / MINUTE) + 1})
    return iv.union(rows, ["session", "speaker"], within=360)


def activity_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every speaker's activity around each click, ten minutes of context on both sides."""
    minutes = _minutes(spark, sf_dir)
    clicks = iv.with_context(minutes.where(F.col("speaker") == "click").drop("speaker"), 10)
    wanted = clicks.join(minutes.select("session", "speaker").distinct(), "session")
    cut = blocks.pieces(wanted, blocks.active_blocks(minutes, ["session", "speaker"], 240), ["session", "speaker"], 240, missing=F.lit(False))
    whole = blocks.stitched(cut, ["session", "speaker", "s", "e"])
    active = F.filter(F.transform("values", lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    digest = F.aggregate(active, F.lit(0).cast("bigint"), lambda total, i: total + i)
    return whole.select("session", "speaker", "s", "e", F.size("values").cast("bigint").alias("n"), F.size(active).cast("bigint").alias("n_active"), digest.alias("digest"))


def segment_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rises of the events a minute inside each stretch of activity: a row for each minute that has one."""
    day = F.unix_micros(F.col("session").cast("timestamp"))
    counts = utterances(spark, sf_dir).groupBy("session", "speaker", F.floor((F.col("s") - day) / MINUTE).alias("frame")).agg(F.count(F.lit(1)).alias("p"))
    spread = counts.select("session", "speaker").distinct().withColumn("frame", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(1439).cast("bigint"))))
    track = spread.join(counts, ["session", "speaker", "frame"], "left").withColumn("p", F.coalesce("p", F.lit(0)))
    segments = iv.union(iv.with_context(_minutes(spark, sf_dir), 2), ["session", "speaker"], within=360).withColumn("e", F.least("e", F.lit(1440)))
    cut = blocks.pieces(segments, blocks.blocked(track, ["session", "speaker"], "frame", "p", 240), ["session", "speaker"], 240)
    rows = estimates.estimated(cut, ["session", "speaker", "s", "e"], estimates.differences, "frame bigint, value bigint")
    return rows.where("value > 0")


def _key_number(props: str | None, value: float | None) -> int:
    if value is None or value < 1:
        raise guarded.Rejected("too short")
    number = json.loads(props)["k"]
    if number % 7 == 0:
        raise ValueError(number)
    return number


def guarded_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number that their properties hold, or the reason why there is none."""
    rows = table(spark, sf_dir, "events").select("event_id", "props", "value")
    result = guarded.guarded(_key_number, "bigint", "props", "value", caught=(guarded.Rejected, ValueError, KeyError))
    kept, refused = guarded.quarantined(rows, result, stages.scratch(spark), "number")
    none = F.lit(None)
    return kept.select("event_id", "number", none.cast("string").alias("reason")).unionByName(refused.select("event_id", none.cast("bigint").alias("number"), "reason"))


def utterance_folder_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations written as a folder of sorted lists and read again."""
    recording = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.squashed(F.col("text")).alias("words"), recording.alias("recording"))
    at = F.col("turn") * 10
    turns = rows.select(
        F.concat_ws("-", "recording", F.lpad(F.col("turn").cast("string"), 5, "0")).alias("utterance"),
        "recording", at.cast("string").alias("start"), (at + 7).cast("string").alias("end"), F.concat_ws("_", "recording", "role").alias("speaker"), "words",
    )
    path = stages.scratch(spark)
    sinks.utterance_folder(turns, rows.select(F.col("recording").alias("key")).distinct().withColumn("value", F.concat(F.lit("/audio/"), "key", F.lit(".wav"))), path)
    lists = {name: texts.read(spark, f"{path}/{name}") for name in ("segments", "utt2spk", "text", "wav.scp", "spk2utt")}
    back = lists["segments"]
    for name, on, column in (("utt2spk", "utterance", "speaker"), ("text", "utterance", "words"), ("wav.scp", "recording", "file")):
        back = back.join(lists[name].withColumnsRenamed({"key": on, "value": column}), on, "left")
    sizes = lists["spk2utt"].select(F.col("key").alias("speaker"), F.size("values").cast("bigint").alias("of_speaker"))
    return back.join(sizes, "speaker").select("utterance", "recording", "start", "end", "speaker", "words", "file", "of_speaker")


def command_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that cut a day's stretches out of a file, read back into file, unit and stretches."""
    spans = iv.union(utterances(spark, sf_dir), ["session", "speaker"], within=60 * MINUTE)
    packed = spans.groupBy("session", "speaker").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("i"))
    path = F.concat(F.lit("/audio of "), "session", F.lit("/"), "speaker", F.lit(".wav"))
    parts = packed.select("session", "speaker", commands.parsed(vectors.trim_command(path, F.col("i"), "s", "norm -0.1")).alias("c"))
    one = parts.select("session", "speaker", "c.path", "c.unit", "c.effect", F.inline("c.intervals"))
    return one.withColumns({x: F.col(x).cast("bigint") for x in "se"})


def channel_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path for each channel of a turn, read back, and the names that follow from it."""
    plain = F.concat(F.lit("/audio.d/c"), F.col("conv_id").cast("string"), F.lit("_noise.v1.wav"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, plain).otherwise(commands.with_channel(plain, F.col("turn"))).alias("given"))
    found = rows.withColumn("_c", commands.channel_of(F.col("given"))).select("conv_id", "turn", "given", "_c.path", "_c.channel")
    name = F.concat(F.lit("_early_ch"), F.coalesce("channel", F.lit(0)).cast("string"))
    return found.select("*", commands.with_stem_end(F.col("path"), "_ch").alias("with_end"), commands.renamed(F.col("path"), "_noise", name).alias("early"))


def cached_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each dimension of each label's vectors, built once and found again."""
    rows = table(spark, sf_dir, "embeddings").select("label", "embedding")
    root = stages.scratch(spark)
    for _ in range(2):
        found = stages.cached([rows], root, lambda: stats.mean_std(rows, "embedding", ["label"]), what="mean_std")
    return found.select("label", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("mean"), 9).alias("mean"), F.round("std", 9).alias("std"), "n")


def speaker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days as maps from speakers to their minutes of activity, and back to rows."""
    each = _minutes(spark, sf_dir).groupBy("session", "speaker").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    days = each.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "spans"))).alias("spans"))
    return reshape.speaker_spans(days, "spans")


def stacked_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as eight channels of eight values, stacked again: the last value of each channel."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("channel"), "embedding")
    rows = rows.withColumn("part", F.slice("embedding", F.col("channel") * 8 + 1, F.lit(8)))
    return reshape.stacked(rows, ["vec_id"], "channel", "part").select("vec_id", F.transform("values", lambda x: F.round(F.get(x, 7).cast("double") * 1000).cast("bigint")).alias("milli"))


def canonical_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of sessions under folder names joined with a table of canonical names, after renaming."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("overlap_ratio_40.0_sil0.1_1.0_session"), F.col("conv_id").cast("string"), F.lit("_actual39.9")).alias("session"))
    known = rows.groupBy(F.concat(F.lit("session"), F.col("conv_id").cast("string"), F.lit("_CH0_OV40")).alias("session")).agg(F.count(F.lit(1)).alias("n_turns"))
    return joins.renamed_ids(rows, "session", ids.canonical(F.col("session"))).join(known, "session")


QUERIES = {f.__name__: f for f in (framewise_slices, activity_slices, segment_signals, guarded_properties, utterance_folder_round_trip, command_round_trip, channel_paths, cached_statistics, speaker_spans, stacked_channels, canonical_sessions)}

_MINUTES = f"""{UTTERANCES}, mm AS (SELECT session, speaker, CAST(floor((s - epoch_us(CAST(session AS TIMESTAMP))) / 60000000) AS BIGINT) AS s,
  CAST(floor((e - 1 - epoch_us(CAST(session AS TIMESTAMP))) / 60000000) AS BIGINT) + 1 AS e FROM u), {union_sql("mm", "session, speaker", "x")}"""

ORACLE_SQL = {
    "framewise_slices": """WITH f AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place,
  CAST(coalesce(floor(CAST(embedding[1] AS DOUBLE) * 1000), 0) AS BIGINT) AS x FROM embeddings),
ends AS (SELECT label, max(place) AS top FROM f GROUP BY label),
ex AS (SELECT vec_id, label, (greatest((640 * place - 120) // 160, 0) // 4) - 5 AS s, CAST(ceil(ceil((16000 * (1 + vec_id % 3) - 240) / 160) / 4) AS BIGINT) AS n FROM f),
g AS (SELECT vec_id, label, s, n, unnest(generate_series(0, n - 1)) AS i FROM ex)
SELECT g.vec_id, g.label, CAST(any_value(g.s) AS BIGINT) AS s, any_value(g.n) AS n, CAST(sum((i + 1) * x) AS BIGINT) AS digest
FROM g JOIN ends ON ends.label = g.label JOIN f ON f.label = g.label AND f.place = greatest(0, least(g.s + i, top)) GROUP BY g.vec_id, g.label""",
    "activity_slices": f"""WITH {_MINUTES}, c AS (SELECT session, greatest(0, s - 10) AS s, e + 10 AS e FROM x WHERE speaker = 'click'),
w AS (SELECT c.*, speaker FROM c JOIN (SELECT DISTINCT session, speaker FROM x) AS n USING (session)),
part AS (SELECT w.session, w.speaker, w.s, w.e, greatest(w.s, x.s) - w.s AS a, least(w.e, x.e) - w.s AS b FROM w JOIN x ON x.session = w.session AND x.speaker = w.speaker AND x.s < w.e AND w.s < x.e)
SELECT w.session, w.speaker, w.s, w.e, any_value(w.e - w.s) AS n, CAST(coalesce(sum(b - a), 0) AS BIGINT) AS n_active, CAST(coalesce(sum((b - a) * (a + b + 1) // 2), 0) AS BIGINT) AS digest
FROM w LEFT JOIN part USING (session, speaker, s, e) GROUP BY w.session, w.speaker, w.s, w.e""",
    "segment_signals": f"""WITH {_MINUTES}, wide AS (SELECT session, speaker, greatest(0, s - 2) AS s, e + 2 AS e FROM x), {union_sql("wide", "session, speaker", "y")},
c AS (SELECT session, speaker, CAST(floor((s - epoch_us(CAST(session AS TIMESTAMP))) / 60000000) AS BIGINT) AS minute, count(*) AS p FROM u GROUP BY ALL),
g AS (SELECT session, speaker, s, least(e, 1440) AS e, unnest(generate_series(s, least(e, 1440) - 1)) AS minute FROM y),
v AS (SELECT g.*, coalesce(p, 0) AS p FROM g LEFT JOIN c USING (session, speaker, minute)),
d AS (SELECT session, speaker, s, e, minute - s AS frame, p - coalesce(lag(p) OVER (PARTITION BY session, speaker, s ORDER BY minute), 0) AS value FROM v)
SELECT session, speaker, s, e, frame, CAST(value AS BIGINT) AS value FROM d WHERE value > 0""",
    "guarded_properties": """WITH r AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
c AS (SELECT event_id, k, CASE WHEN value IS NULL OR value < 1 THEN 'too short' WHEN k % 7 = 0 THEN 'ValueError: ' || k END AS reason FROM r)
SELECT event_id, CASE WHEN reason IS NULL THEN k END AS number, reason FROM c""",
    "utterance_folder_round_trip": """WITH t AS (SELECT 'c' || conv_id AS recording, turn, role, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS words FROM conversations),
n AS (SELECT recording, role, count(*) AS of_speaker FROM t GROUP BY ALL)
SELECT recording || '-' || lpad(CAST(turn AS VARCHAR), 5, '0') AS utterance, recording, CAST(turn * 10 AS VARCHAR) AS start, CAST(turn * 10 + 7 AS VARCHAR) AS "end",
  recording || '_' || role AS speaker, words, '/audio/' || recording || '.wav' AS file, of_speaker FROM t JOIN n USING (recording, role)""",
    "command_round_trip": f"""WITH {UTTERANCES}, {union_sql("u", "session, speaker", "x")}
SELECT session, speaker, '/audio of ' || session || '/' || speaker || '.wav' AS path, 's' AS unit, 'norm -0.1' AS effect, s, e FROM x""",
    "channel_paths": """WITH r AS (SELECT conv_id, turn, '/audio.d/c' || conv_id || '_noise.v1.wav' AS path, CASE WHEN turn % 3 <> 0 THEN CAST(turn AS INT) END AS channel FROM conversations)
SELECT *, path || CASE WHEN channel IS NULL THEN '' ELSE '::[:,' || channel || ':' || (channel + 1) || ']' END AS given,
  '/audio.d/c' || conv_id || '_noise.v1_ch.wav' AS with_end, '/audio.d/c' || conv_id || '_early_ch' || coalesce(channel, 0) || '.v1.wav' AS early FROM r""",
    "cached_statistics": """WITH d AS (SELECT label, unnest(generate_series(0, len(embedding) - 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, count(x) AS n FROM d GROUP BY ALL""",
    "speaker_spans": f"WITH {_MINUTES} SELECT session, speaker, s, e FROM x",
    "stacked_channels": "SELECT vec_id, list_transform(range(1, 9), lambda i: CAST(round(CAST(embedding[8 * i] AS DOUBLE) * 1000) AS BIGINT)) AS milli FROM embeddings",
    "canonical_sessions": "SELECT conv_id, turn, 'session' || conv_id || '_CH0_OV40' AS session, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM conversations",
}
