"""Queries that write the tables in every format, read them again and go on with what came back; and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions.units import rounded
from ..operators import intervals as iv
from ..operators import joins, reshape, stats
from ..sources import documents, sinks, texts
from . import stages
from .common import UTTERANCES, table, union_sql, utterances

SEVENTH = 10_000_000


def _units(*names: str) -> dict[str, Column]:
    """Decimal seconds as whole units of their seventh digit."""
    return {n: (F.col(n) * SEVENTH).cast("bigint") for n in names}


def _seconds(micros: Column) -> Column:
    return (micros.cast("decimal(20,0)") * F.expr("0.000001BD")).cast("decimal(18,7)")


def rttm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of activity as RTTM under folder names, read back under canonical names."""
    spans = iv.union(utterances(spark, sf_dir), ["session", "speaker"], within=3_600_000_000)
    day = F.unix_micros(F.col("session").cast("timestamp"))
    number = F.date_diff(F.col("session").cast("date"), F.lit("1970-01-01").cast("date")).cast("string")
    rows = spans.select(
        F.concat(F.lit("overlap_ratio_40.0_sil0.1_1.0_session"), number, F.lit("_actual39.9")).alias("session_id"),
        "speaker", _seconds(F.col("s") - day).alias("start_time"), _seconds(F.col("e") - F.col("s")).alias("duration"),
    )
    path = stages.scratch(spark)
    sinks.rttm(rows, path)
    sinks.rttm(rows.limit(0), path)  # a list that is there stays
    return texts.rttm(spark, path, ids.canonical).withColumns(_units("start_time", "duration"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_id, channel, speaker, start_time, end_time, words`` of the turns, ten seconds apart."""
    at = F.col("turn").cast("decimal(11,0)") * 10
    words = F.coalesce(text.squashed(F.col("text")), F.lit(""))
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_CH0_x"))
    return table(spark, sf_dir, "conversations").select(
        name.alias("session_id"), F.lit("1").alias("channel"), F.col("role").alias("speaker"),
        (at + F.expr("0.25BD")).cast("decimal(18,7)").alias("start_time"), (at + F.expr("7.0000625BD")).cast("decimal(18,7)").alias("end_time"), words.alias("words"),
    )


def stm_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an STM file, read back and normalised."""
    path = stages.scratch(spark)
    sinks.stm(_turns(spark, sf_dir), path)
    return texts.normalised(texts.stm(spark, path)).withColumns(_units("start_time", "end_time"))


def segment_list_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lists of segments with exact decimal times, read back."""
    day = F.unix_micros(F.col("session").cast("timestamp"))
    rows = utterances(spark, sf_dir).select(
        F.col("session").alias("session_id"), "speaker", _seconds(F.col("s") - day).alias("start_time"), _seconds(F.col("e") - day).alias("end_time"),
        F.concat(F.lit("/audio/"), F.col("user_id").cast("string"), F.lit(".wav")).alias("file"), F.col("user_id").alias("stop_sample"),
    )
    path = stages.scratch(spark)
    sinks.seglst(rows, path)
    back = documents.seglst(spark, path).withColumns(_units("start_time", "end_time"))
    return back.select("session_id", "speaker", "start_time", "end_time", "audio_path", "end_sample")


def meeting_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as tab-separated tables, a folder for each role, read back with the name from the path."""
    turns = _turns(spark, sf_dir).select("start_time", "end_time", "speaker", F.concat_ws("-", "session_id", "start_time").alias("utterance_id"), F.concat(F.lit('"'), "words", F.lit('" said')).alias("transcription"), F.col("speaker").alias("meeting"))
    path = stages.scratch(spark)
    turns.write.partitionBy("meeting").csv(path, sep="\t", header=True, quote='"', escape='"')
    return texts.meeting_info(spark, f"{path}/meeting=*/*", r"/meeting=([^/]+)/[^/]+$").withColumns(_units("start_time", "end_time"))


def scanned_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of each language's documents, found by a pattern, with the language from the path."""
    rows = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), F.col("doc_id").cast("string").alias("key"), F.concat_ws(" ", "source", F.col("n_chars").cast("string")).alias("value"))
    path = stages.scratch(spark)
    sinks.key_value(rows, path, dataset="lang")
    return texts.key_value(spark, f"{path}/dataset=*/*.txt", texts.DATASET)


def aligned_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as an alignment file, a list of durations and a list of a model's words, read back and joined."""
    words = F.coalesce(text.squashed(F.col("text")), F.lit(""))
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), "turn", "role", words.alias("words"))
    found = F.concat_ws(" ", "role", "words")
    tagged = lambda tag, value: F.struct(F.concat_ws(" ", "key", F.lit(tag)).alias("key"), value.alias("value"))
    counts = F.concat_ws(" ", *[x.cast("string") for x in (F.length("words"), F.lit(0), F.col("turn"), F.lit(1))])
    lines = rows.select(F.inline(F.array(tagged("ref", F.col("words")), tagged("hyp", found), tagged("op", F.lit("C  S D")), tagged("#csid", counts))))
    path = stages.scratch(spark)
    sinks.key_value(lines, f"{path}/per_utt")
    sinks.key_value(rows.select("key", F.concat((F.col("turn") * 3).cast("string"), F.lit(".5")).alias("value")), f"{path}/utt2dur")
    model = sinks.hypotheses(rows.select("key", found.alias("words")), path, "small")
    each = texts.read(spark, f"{path}/per_utt").join(texts.read(spark, f"{path}/utt2dur").withColumnsRenamed({"key": "utterance", "value": "seconds"}), "utterance")
    each = each.join(texts.read(spark, model).withColumnsRenamed({"key": "utterance", "value": "words"}), "utterance")
    place = lambda i: F.get("csid", i).cast("bigint")
    return each.select("utterance", "ref", "hyp", "op", place(0).alias("n_right"), place(2).alias("n_inserted"), F.size("csid").cast("bigint").alias("n_counts"), "seconds", "words")


def simulated_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of mixtures; the utterances of the mixtures of just four speakers."""
    entry = F.struct(F.col("l_linenumber").alias("place"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("speaker_id"), F.concat(F.lit("/src/"), F.col("l_partkey").cast("string"), F.lit(".wav")).alias("path"), (F.col("l_linenumber") * 16_000 + F.col("l_quantity").cast("bigint")).alias("offset_in_samples"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", entry.alias("i"))
    inputs = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("i")).alias("inputs"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1000).alias("t60"), (-F.col("o_totalprice")).alias("snr"))
    mixtures = inputs.join(orders, "l_orderkey").select(F.concat(F.lit("mix"), F.col("l_orderkey").cast("string")).alias("output"), "inputs", F.array_distinct("inputs.speaker_id").alias("speakers"), "t60", "snr")
    path = stages.scratch(spark)
    sinks.seglst(mixtures, path)
    examples = documents.enough_speakers(documents.mix_log(spark, path), F.col("inputs.speaker_id"), 4)
    packed = examples.select("output", "sound_decay_time", "snr", *[F.col(f"inputs.{c}").alias(c) for c in ("speaker_id", "path", "offset_in_samples")])
    return reshape.utterances(packed, ["output", "sound_decay_time", "snr"], ["speaker_id", "path", "offset_in_samples"])


def selected_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as examples in a database of lines; three configurations name their datasets; regions by default."""
    start = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey"))
    given = F.when(F.col("c_custkey") % 5 == 0, F.struct(F.lit(1).cast("bigint").alias("s"), F.lit(2).cast("bigint").alias("e")))
    balance = F.round(F.col("c_acctbal") * 100).cast("bigint")
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_name").alias("example_id"), F.struct(start.alias("start"), (F.col("c_custkey") * 10).alias("end"), given.alias("uem"), F.array(balance, F.col("c_nationkey").cast("bigint")).alias("offset")).alias("example"))
    path = stages.scratch(spark)
    sinks.database_lines(rows, f"{path}/all")
    where = {"path": "{root}/all", "lines": True}
    configs = {"a": where | {"datasets": ["BUILDING", "AUTOMOBILE"]}, "b": where | {"datasets": ["MACHINERY"]}, "c": where | {"datasets": ["HOUSEHOLD", "FURNITURE"]}, "d": {"path": "{root}/isn't there"}}
    found = documents.selected(spark, configs, ["a", "b", "c"], "STRUCT<start: BIGINT, `end`: BIGINT, uem: STRUCT<s: BIGINT, e: BIGINT>, offset: ARRAY<BIGINT>>", root=path)
    whole = reshape.with_default_region(found.select("dataset", "example_id", "example.*"))
    return whole.select("dataset", "example_id", "uem.s", "uem.e", F.get("offset", 0).alias("balance"), F.get("offset", 1).alias("nation"))


def database_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in a table with a folder for each dataset, of which a selection reads its own only."""
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dataset"), F.col("s_name").alias("example_id"), F.col("s_suppkey").alias("n"))
    path = stages.scratch(spark)
    sinks.database(rows, path)
    found = spark.read.parquet(path)
    few = found.where(F.col("dataset").isin("n1", "n2", "n3"))
    rest = found.where(~F.col("dataset").isin("n1", "n2", "n3"))
    return documents.union([few.withColumn("few", F.lit(True)), rest])


def speaker_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four vectors to a recording; examples of it that name all its speakers, some, or none of their own."""
    number = F.floor(F.col("vec_id") / 4)
    recording = F.concat(F.lit("m"), number.cast("string"))
    name = F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string"))
    path = F.when(F.col("vec_id") % 37 == 0, "").otherwise(F.concat(F.lit("/v/"), F.col("vec_id").cast("string")))
    held = table(spark, sf_dir, "embeddings").select(recording.alias("example_id"), name.alias("speaker_id"), (F.col("vec_id") % 4).alias("ord"), path.alias("path"), "embedding")
    known = held.groupBy("example_id").agg(F.array_sort(F.collect_list("speaker_id")).alias("s"))
    speakers = F.when(F.col("c") == 0, F.concat(F.reverse("s"), F.col("s"))).when(F.col("c") == 1, F.slice("s", 1, 2)).otherwise(F.array(F.lit("0")))
    channels = known.withColumn("c", F.explode(F.array(*[F.lit(c) for c in range(4)])))
    parent = F.when(F.col("c") < 3, F.col("example_id")).otherwise(F.lit("nowhere"))
    examples = channels.select(F.concat_ws("_", "example_id", F.col("c").cast("string")).alias("example_id"), parent.alias("embedding_id"), speakers.alias("speaker_id"), (F.col("c") >= 2).alias("estimate"))
    found = joins.speaker_vectors(examples, held, estimate=F.col("estimate"))
    milli = F.transform("vectors", lambda v, i: (i + 1) * F.coalesce(F.floor(F.get(v, 0).cast("double") * 1000), F.lit(0)))
    return found.select("example_id", "reason", F.size("vectors").cast("bigint").alias("n"), F.aggregate(milli, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("digest"))


def auxiliary_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation over matrices of vectors, each vector with the last element of its own behind it."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.concat("embedding", F.slice("embedding", -1, 1)).alias("v"))
    packed = reshape.examples(rows.withColumn("m", F.floor(F.col("vec_id") / 10)), ["label", "m"], "vec_id", ["v"])
    found = stats.auxiliary_mean_std(packed, "v", ["label"])
    return found.select("label", F.col("dim").cast("bigint").alias("dim"), rounded(F.col("mean"), 9).alias("mean"), F.round("std", 9).alias("std"), "n")


def channel_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of parts as a row for each microphone, the other paths cut to its channel."""
    c = F.sequence(F.lit(0), F.lit(2))
    key = F.col("p_partkey").cast("string")
    files = F.transform(c, lambda i: F.concat(F.lit("/audio/U0"), (i + 1).cast("string"), F.lit(".CH"), i.cast("string"), F.lit(".wav")))
    noise = F.concat(F.lit("/noise/"), key, F.lit(".wav"))
    early = F.transform(c, lambda i: F.concat(F.lit("/early/"), key, F.lit("."), i.cast("string")))
    rir = F.array(F.concat(F.lit("/rir/a"), key), F.concat(F.lit("/rir/b"), key))
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dataset"), key.alias("example_id"), files.alias("observation"), noise.alias("noise_image"), early.alias("early"), rir.alias("rir"))
    cut = reshape.explode_channels(rows, "example_id", "observation", ids.channel_suffix, parallel=["noise_image", "early"], each=["rir"], within=["dataset"])
    return cut.select("dataset", "example_id", "parent", "observation", "noise_image", F.concat_ws(" ", "early").alias("early"), F.concat_ws(" ", "rir").alias("rir"))


def collapsed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as parallel arrays; what is the same in every turn of a conversation is kept once."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"), F.concat(F.lit("d"), (F.col("conv_id") % 7).cast("string")).alias("dataset"))
    packed = reshape.examples(rows, ["conv_id"], "turn", ["turn", "n"], ["dataset"])
    return packed.select("conv_id", "dataset", F.concat_ws(",", F.col("turn").cast("array<string>")).alias("turns"), F.concat_ws(",", F.col("n").cast("array<string>")).alias("lengths"))


QUERIES = {
    f.__name__: f
    for f in (
        rttm_round_trip, stm_round_trip, segment_list_round_trip, meeting_tables, scanned_lists, aligned_utterances, simulated_examples, selected_datasets,
        database_folders, speaker_vectors, auxiliary_mean_std, channel_slices, collapsed_examples,
    )
}

_WORDS = "coalesce(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '')"
_DAY = "epoch_us(CAST(session AS TIMESTAMP))"

ORACLE_SQL = {
    "rttm_round_trip": f"""WITH {UTTERANCES}, {union_sql("u", "session, speaker", "x")}
SELECT 'session' || date_diff('day', DATE '1970-01-01', CAST(session AS DATE)) || '_CH0_OV40' AS session_id, speaker, (s - {_DAY}) * 10 AS start_time, (e - s) * 10 AS duration FROM x""",
    "stm_round_trip": f"""SELECT 'c' || conv_id || '_x' AS session_id, '1' AS channel, role AS speaker, turn * 100000000 + 2500000 AS start_time, turn * 100000000 + 70000625 AS end_time,
  trim(translate({_WORDS}, '-?,.!', ' ')) AS words FROM conversations""",
    "segment_list_round_trip": f"""WITH {UTTERANCES} SELECT session AS session_id, speaker, (s - {_DAY}) * 10 AS start_time, (e - {_DAY}) * 10 AS end_time, '/audio/' || user_id || '.wav' AS audio_path, user_id AS end_sample FROM u""",
    "meeting_tables": f"""SELECT turn * 100000000 + 2500000 AS start_time, turn * 100000000 + 70000625 AS end_time, role AS speaker,
  'c' || conv_id || '_CH0_x-' || (turn * 10) || '.2500000' AS utterance_id, '"' || {_WORDS} || '" said' AS transcription, role AS meeting FROM conversations""",
    "scanned_lists": "SELECT coalesce(lang, 'none') AS dataset, CAST(doc_id AS VARCHAR) AS key, concat_ws(' ', source, CAST(n_chars AS VARCHAR)) AS value FROM documents",
    "aligned_utterances": f"""WITH r AS (SELECT 'c-' || conv_id || '-' || turn AS utterance, turn, role, {_WORDS} AS w FROM conversations)
SELECT utterance, w AS ref, trim(role || ' ' || w) AS hyp, 'C S D' AS op, length(w) AS n_right, turn AS n_inserted, CAST(4 AS BIGINT) AS n_counts, turn * 3 + CAST(0.5 AS DOUBLE) AS seconds, trim(role || ' ' || w) AS words FROM r""",
    "simulated_examples": """WITH l AS (SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS speaker_id, '/src/' || l_partkey || '.wav' AS path, l_linenumber * 16000 + CAST(trunc(l_quantity) AS BIGINT) AS offset_in_samples FROM lineitem),
four AS (SELECT l_orderkey FROM l GROUP BY l_orderkey HAVING count(DISTINCT speaker_id) = 4)
SELECT 'mix' || l_orderkey AS output, o_totalprice / 1000 AS sound_decay_time, -o_totalprice AS snr, CAST(row_number() OVER (PARTITION BY l_orderkey, o_orderkey ORDER BY l_linenumber, speaker_id, path, offset_in_samples) - 1 AS INT) AS ord,
  speaker_id, path, offset_in_samples FROM l JOIN four USING (l_orderkey) JOIN orders ON o_orderkey = l_orderkey""",
    "selected_datasets": """SELECT c_mktsegment AS dataset, c_name AS example_id, CASE WHEN c_custkey % 5 = 0 THEN 1 WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS s,
  CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE c_custkey * 10 END AS e, CAST(round(c_acctbal * 100) AS BIGINT) AS balance, CAST(c_nationkey AS BIGINT) AS nation FROM customer""",
    "database_folders": "SELECT 'n' || s_nationkey AS dataset, s_name AS example_id, s_suppkey AS n, CASE WHEN s_nationkey IN (1, 2, 3) THEN true END AS few FROM supplier",
    "speaker_vectors": """WITH v AS (SELECT vec_id // 4 AS m, vec_id % 4 AS k, vec_id % 37 = 0 AS gone, CAST(coalesce(floor(CAST(embedding[1] AS DOUBLE) * 1000), 0) AS BIGINT) AS x FROM embeddings),
g AS (SELECT m, count(*) AS n, bool_or(gone) AS gone, sum((k + 1) * x) AS up, sum((n_all - k) * x) AS down FROM (SELECT *, count(*) OVER (PARTITION BY m) AS n_all FROM v) GROUP BY m),
e AS (SELECT *, unnest([0, 1, 2, 3]) AS c FROM g),
r AS (SELECT *, CASE WHEN c = 3 THEN 'no vectors' WHEN c = 1 AND n > 2 THEN 'other speakers' WHEN c < 2 AND gone THEN 'an empty path' END AS reason FROM e)
SELECT 'm' || m || '_' || c AS example_id, reason, CASE WHEN reason IS NULL THEN n END AS n, CASE WHEN reason IS NULL THEN CAST(CASE WHEN c = 0 THEN down ELSE up END AS BIGINT) END AS digest FROM r""",
    "auxiliary_mean_std": """WITH d AS (SELECT label, unnest(generate_series(0, len(embedding))) AS dim, CAST(unnest(list_append(embedding, embedding[-1])) AS DOUBLE) AS x FROM embeddings)
SELECT label, dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, count(x) AS n FROM d GROUP BY ALL""",
    "channel_slices": """SELECT p_brand AS dataset, p_partkey || '_U0' || (c + 1) || 'CH' || c AS example_id, CAST(p_partkey AS VARCHAR) AS parent, '/audio/U0' || (c + 1) || '.CH' || c || '.wav' AS observation,
  '/noise/' || p_partkey || '.wav::[:,' || c || ':' || (c + 1) || ']' AS noise_image, '/early/' || p_partkey || '.' || c AS early,
  '/rir/a' || p_partkey || '::[:,' || c || ':' || (c + 1) || '] /rir/b' || p_partkey || '::[:,' || c || ':' || (c + 1) || ']' AS rir FROM part, (VALUES (0), (1), (2)) AS w(c)""",
    "collapsed_examples": """SELECT conv_id, 'd' || (conv_id % 7) AS dataset, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn, length(text)) AS turns, string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY turn, length(text)) AS lengths FROM conversations GROUP BY conv_id""",
}
