"""Queries of lookups, of joins of line-oriented tables and of small aggregates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.units import rounded
from ..operators import lookups, stats
from .common import table, union_sql


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turns as segments of ten-second slots, their speakers, and the conversations' recordings."""
    rows = table(spark, sf_dir, "conversations")
    recording = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    at = F.col("turn") * 10
    text = lambda n, tail: F.concat(n.cast("bigint").cast("string"), F.lit(tail))
    key = F.concat_ws("-", recording, F.col("turn").cast("string"))
    segments = rows.select(key.alias("utterance"), recording.alias("recording"), text(at, ".5").alias("start"), text(at + 1 + F.length("text") % 9, ".25").alias("end"))
    speaker = F.when(F.col("conv_id") % 2 == 0, F.concat_ws("_", recording, "role")).otherwise(F.col("role"))
    recordings = rows.select(recording.alias("key")).distinct().withColumn("value", F.concat(F.lit("/audio/"), "key", F.lit(".wav")))
    return segments, rows.select(key.alias("key"), speaker.alias("value")), recordings


def speaker_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.speaker_recordings(*_turns(spark, sf_dir))


def speaker_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that last three slots more, so that turns of one speaker overlap."""
    segments, speakers, _ = _turns(spark, sf_dir)
    longer = segments.withColumn("end", (F.col("end").cast("decimal(18,7)") + 30).cast("string"))
    return lookups.speaker_intervals(longer, speakers, within=16_000 * 600)


def id_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of recordings and utterances, made of pages, in both readings and the older one."""
    n = F.col("page_id").cast("string")
    joined = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        joined("overlap_ratio_40.0_sil0.1_1.0_session", n, "_actual39.9"),
        joined("overlap_ratio_0.0_sil2.9_3.0_session", n, "_actual0.0"),
        joined("session", n, "_CH0_OV10"),
        joined("1089_session", n, "_CH0_0S_003830_004658"),
        joined("7_overlap_ratio_30.0_sil0.1_1.0_session", n, "_actual30.4"),
        joined("session", n, "_CH3_0L_more"),
        joined("0S_session", n),
    ]
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "name"))
    name = F.col("name")
    return rows.select("page_id", "form", ids.canonical(name).alias("recording"), ids.canonical(name, True).alias("utterance"), ids.short(name).alias("short"), ids.canonical_by_prefix(name).alias("prefix"))


def static_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations to regions; regions stay, market segments are neither."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    rows = nations.select(F.col("n_name").alias("name")).unionByName(regions.select(F.col("r_name").alias("name")))
    rows = rows.unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")))
    return lookups.translated(rows, names, "name", "region", F.lit("none")).groupBy("name", "region").agg(F.count(F.lit(1)).alias("n"))


def filled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document's language from the greatest one of its source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    known = rows.groupBy("source").agg(F.max("lang").alias("lang"))
    return lookups.filled(rows.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang"))), known, "source", "lang")


def speaker_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with its role's place among its conversation's roles in order of appearance."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    first = rows.groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    order = first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"]).alias("roles"))
    return rows.join(order, "conv_id").select("conv_id", "turn", "roles", lookups.place_in(F.col("roles"), F.col("role")).alias("place"))


def ragged_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest length of the words of each document, none for a document without words."""
    sizes = F.transform(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").select("doc_id", sizes.alias("a"))
    return rows.select("doc_id", F.array_min("a").cast("bigint").alias("low"), F.array_max("a").cast("bigint").alias("high"))


def mean_over_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as masks of eight frames of eight bins: the mean of each frame, by label."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", F.floor(F.col("dim") / 8).alias("frame")).agg(rounded(F.avg(F.col("x").cast("double")), 9).alias("activity"))


def mean_without_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean length of turns by conversation and role, the turn left out of the path."""
    rows = table(spark, sf_dir, "conversations").select(F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("path"), F.length("text").alias("v"))
    return stats.mean_without(rows, "path", 2, "v").select(F.array_join("path", "/").alias("path"), rounded(F.col("mean"), 9).alias("mean"), "n")


def min_loss_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest order of each priority, the first of equal ones."""
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("chosen"), F.min("o_totalprice").alias("loss"))


QUERIES = {
    f.__name__: f
    for f in (
        speaker_recordings, speaker_intervals, id_modes, static_names, filled_languages, speaker_positions, ragged_extent, mean_over_frequency, mean_without_part,
        min_loss_choice,
    )
}

_TURNS = """t AS (SELECT 'c' || conv_id AS recording, CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id || '_' || role ELSE role END AS speaker, conv_id, turn, turn * 10 AS a, turn * 10 + 1 + length(text) % 9 AS b FROM conversations)"""

ORACLE_SQL = {
    "speaker_recordings": f"""WITH {_TURNS} SELECT CASE WHEN conv_id % 2 = 0 THEN speaker ELSE recording || '-' || speaker END AS key, recording, speaker,
'sox -t wav /audio/' || recording || '.wav -t wav - trim ' || string_agg('=' || a || '.5 =' || b || '.25', ' ' ORDER BY turn) || ' |' AS value FROM t GROUP BY conv_id, recording, speaker""",
    "speaker_intervals": f"""WITH {_TURNS}, v AS (SELECT recording, speaker, CAST(a * 16000 + 8000 AS BIGINT) AS s, CAST((b + 30) * 16000 + 4000 AS BIGINT) AS e FROM t),
{union_sql("v", "recording, speaker", "x")} SELECT recording, speaker, s, e FROM x""",
    "id_modes": """SELECT page_id, CAST(form AS INT) AS form,
CASE form WHEN 0 THEN 'session' || page_id || '_CH0_OV40' WHEN 1 THEN 'session' || page_id || '_CH0_0L' WHEN 2 THEN 'session' || page_id || '_CH0_OV10' WHEN 6 THEN 'session' || page_id || '_CH0_0S' END AS recording,
CASE form WHEN 3 THEN 'session' || page_id || '_CH0_0S' WHEN 4 THEN 'session' || page_id || '_CH0_OV30' END AS utterance,
CASE form WHEN 0 THEN 'session' || page_id || '_OV40' WHEN 1 THEN 'session' || page_id || '_0L' WHEN 2 THEN 'session' || page_id || '_OV10' WHEN 6 THEN 'session' || page_id || '_0S' END AS short,
CASE form WHEN 0 THEN 'session' || page_id || '_CH0_OV40' WHEN 1 THEN 'session' || page_id || '_CH0_0L' WHEN 2 THEN 'session' || page_id || '_CH0_OV10' WHEN 5 THEN 'session' || page_id || '_CH3_0L_more' END AS prefix
FROM pages, generate_series(0, 6) AS g(form)""",
    "static_names": """WITH names AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
rows AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer)
SELECT name, coalesce((SELECT min(r_name) FROM names WHERE n_name = name), (SELECT min(r_name) FROM region WHERE r_name = name), 'none') AS region, count(*) AS n FROM rows GROUP BY name""",
    "filled_languages": """WITH k AS (SELECT source, max(lang) AS m FROM documents GROUP BY source)
SELECT doc_id, d.source, CASE WHEN doc_id % 3 <> 0 AND lang IS NOT NULL THEN lang ELSE m END AS lang FROM documents AS d LEFT JOIN k ON d.source = k.source""",
    "speaker_positions": """WITH f AS (SELECT conv_id, role, min(turn) AS first_turn FROM conversations GROUP BY ALL), o AS (SELECT conv_id, list(role ORDER BY first_turn, role) AS roles FROM f GROUP BY conv_id)
SELECT conv_id, turn, roles, CAST(list_position(roles, role) - 1 AS BIGINT) AS place FROM conversations JOIN o USING (conv_id)""",
    "ragged_extent": """SELECT doc_id, CAST(list_min(a) AS BIGINT) AS low, CAST(list_max(a) AS BIGINT) AS high FROM (
SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda w: w <> ''), lambda w: length(w)) AS a FROM documents)""",
    "mean_over_frequency": """WITH d AS (SELECT label, unnest(generate_series(0, 63)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT label, CAST(dim // 8 AS BIGINT) AS frame, round(avg(x), 9) AS activity FROM d GROUP BY ALL""",
    "mean_without_part": "SELECT conv_id || '/' || role AS path, round(avg(length(text)), 9) AS mean, count(*) AS n FROM conversations GROUP BY conv_id, role",
    "min_loss_choice": "SELECT o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS chosen, min(o_totalprice) AS loss FROM orders GROUP BY ALL",
}
