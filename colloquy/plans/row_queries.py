"""Queries of statistics, joins, reshaping, text and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import access, ids, text, vectors
from ..functions.units import rounded
from ..operators import joins, reshape, score, stats
from ..sources.documents import union
from . import stages
from .common import table


def feature_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.mean_std(table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select("dim", rounded(F.col("mean"), 9).alias("mean"), F.round("std", 9).alias("std"), "n")


def channelwise_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.mean_std(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return rows.select("label", "dim", rounded(F.col("mean"), 9).alias("mean"), F.round("std", 9).alias("std"), "n")


def merged_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviations out of moments stored by order status, merged by order priority."""
    parts = stats.moments(table(spark, sf_dir, "orders"), F.col("o_totalprice"), ["o_orderpriority", "o_orderstatus"])
    rows = stats.merged_moments(parts, ["o_orderpriority"])
    return rows.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _adapt(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    source, target = (stats.as_arrays(stats.mean_std(rows.where(w), "embedding")) for w in ("label < 5", "label >= 5"))
    moved = stats.adapted(rows.where("label < 5"), "embedding", source, target, method)
    return moved.select("vec_id", F.transform("embedding", lambda x: rounded(x, 6)).alias("embedding"))


def domain_adapt_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark, sf_dir, "mean_std")


def domain_adapt_mean_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark, sf_dir, "mean_scale")


def domain_adapt_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adapt(spark, sf_dir, "mean")


def lower_median_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity)").alias("median"))


def value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.profile(table(spark, sf_dir, "events"), "value", ["event_type"])


def error_rate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned against all quantities by flag, status and year, in four levels."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_linestatus", F.year("l_shipdate").alias("year"), "l_returnflag",
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("bigint")).otherwise(0).alias("errors"), F.col("l_quantity").cast("bigint").alias("length"),
    )
    keys = ["l_linestatus", "year", "l_returnflag"]
    return score.rollup(rows, keys, [keys, keys[:2], keys[:1], []]).withColumn("error_rate", F.round("error_rate", 9))


def average_of_reference_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all event types over the hours that the type ``error`` has."""
    rows = table(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"), F.lit(1).cast("bigint").alias("length"), (F.col("value") > 10).cast("bigint").alias("errors"))
    kept = score.of_reference_keys(rows, "hour", rows.where("event_type = 'error'"))
    return score.rollup(kept, ["hour"], [["hour"], []]).withColumn("error_rate", F.round("error_rate", 9))


def leave_one_out_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return score.leave_one_out(rows, ["o_custkey"], "cents")


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.inverted(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey")


def nested_example_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("bigint").alias("n"))
    return reshape.examples(rows, ["conv_id"], "turn", ["turn", "role", "n"])


def explode_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.utterances(nested_example_build(spark, sf_dir), ["conv_id"], ["turn", "role", "n"])


def channel_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.concat(F.lit("/audio/"), F.col("p_brand"), F.lit("/U0"), (c + 1).cast("string"), F.lit(".CH"), c.cast("string"), F.lit(".wav")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("example_id"), files.alias("file"))
    return reshape.explode_channels(rows, "example_id", "file", ids.channel_suffix)


def bcast_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "label")
    return reshape.broadcast_channels(rows, "key", 7)


def retention_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reshape.retention(rows, F.coalesce("quality", F.lit(1)) == 1, 3)


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def min_length_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long enough events, the rows of a day together and the latest first."""
    rows = table(spark, sf_dir, "events").where("value >= 5").select(F.col("ts").cast("date").cast("string").alias("session"), "event_id", "value")
    return rows.repartition("session").sortWithinPartitions(F.desc("session"), F.desc("event_id"))


def speaker_set_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers whose line statuses are the same set as their order statuses."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = orders.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("a"))
    both = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_set("l_linestatus").alias("b"))
    return a.join(both, "o_custkey").select("o_custkey", joins.same_sets(F.col("a"), F.col("b")).alias("same"))


def key_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations, some with a channel at the end, by the exact key or without it."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), "n_regionkey")
    rows = nations.select(F.explode(F.array("key", F.concat("key", F.lit("_ch1")), F.concat("key", F.lit("_x")))).alias("key"))
    return joins.with_fallback(rows, nations, "key", ids.without_channel(F.col("key")), "n_regionkey")


def prefix_offset_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands by prefix: a value only where all that begin so share it."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("key")).agg(F.min("p_size").alias("value"))
    keys = parts.select(F.explode(F.array(F.col("key"), F.substring("key", 1, 5), F.substring("key", 1, 7))).alias("key")).distinct()
    return joins.by_prefix(keys, parts, "key", "value")


def source_lookup_inner_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers found and missed by the orders' keys."""
    found, missed = joins.lookup(table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey"), table(spark, sf_dir, "orders").select("o_custkey").distinct(), "o_custkey")
    count = lambda df, name: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias(name))
    return count(found, "n_found").join(count(missed, "n_missed"), "c_mktsegment", "full").select("c_mktsegment", F.coalesce("n_found", F.lit(0)).alias("n_found"), F.coalesce("n_missed", F.lit(0)).alias("n_missed"))


def kaldi_tables_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First turn of each role in a conversation, with the speaker in its key."""
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "role").alias("key"), "turn", F.length("text").cast("bigint").alias("n"))
    return joins.first_of_equals(rows, ["key"], ["turn"])


def union_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t, key: table(spark, sf_dir, t).select(F.lit(t).alias("dataset"), F.col(key).alias("id"))
    parts = [names("documents", "doc_id"), names("labels", "doc_id").withColumn("labelled", F.lit(True)), names("pages", "page_id")]
    return union(parts).groupBy("dataset", "labelled").agg(F.count("id").alias("n"), F.max("id").alias("last"))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").exceptAll(table(spark, sf_dir, "labels").select("doc_id").distinct())


def disjoint_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    ids_of = lambda w: labels.where(w).select("doc_id")
    return ids_of("toxic = 1").intersect(ids_of("quality = 1")).agg(F.count(F.lit(1)).alias("n_shared"))


def distinct_file_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model over the distinct sources of documents, joined back to all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return joins.once_for_each(rows, "source", lambda d: stages.transcribed(d, "source", "stub"), F.col("n_chars")).select("doc_id", "source", "words")


def id_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of pages: recordings to one form; ratios with another's silences, other channels and URLs are unknown."""
    n = F.col("page_id").cast("string")
    forms = [
        F.concat(F.lit("overlap_ratio_"), (F.col("page_id") % 5 * 10).cast("string"), F.lit(".0_sil0.1_0.5_session"), n, F.lit("_actual9.9")),
        F.concat(F.lit("session"), n, F.lit("_0L")),
        F.concat(F.lit("OV20_session"), n),
        F.concat(F.lit("1089_session"), n, F.lit("_CH3_0S_003830_004658")),
        F.col("url"),
    ]
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "name"))
    return rows.select("page_id", "form", ids.canonical(F.col("name")).alias("canonical"), ids.split_of(F.col("name")).alias("split"), ids.sanitised(F.col("name")).alias("safe"), ids.without_last_token(F.col("name")).alias("stem"), ids.numbered(F.col("page_id"), 4).alias("number"))


def transcript_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    upper, original = text.uppercase_keeping_original(F.regexp_replace("text", "[^ -~]", "x"), F.lit(None).cast("string"))
    return rows.select("conv_id", "turn", text.cleaned(F.col("text")).alias("cleaned"), text.squashed(F.regexp_replace("text", "[^ -~\n]", "x")).alias("squashed"), upper.alias("words"), original.alias("words_orig"), text.scored(upper).alias("scored"))


def json_path_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k BIGINT")
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(F.array(props["k"], props["k"] + 1, props["k"] + 2).alias("a")).alias("p"))
    pick = lambda path: access.item(F.col("p"), path)
    return rows.select("event_id", pick("['a'][0]").alias("first"), pick("['a'][1:][-1]").alias("last"), pick("[a][:2]").alias("two"), pick("['a'][::-1]").alias("back"))


def mulaw_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1000 / 999).alias("x"))
    q = vectors.mulaw(F.col("x"))
    return rows.select("event_id", q.alias("q"), F.round(vectors.inverse_mulaw(q), 9).alias("back"), vectors.eight_bit(F.col("x")).alias("linear"))


def upsample_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.upsample(F.col("embedding"), 4, 250).alias("v"))


def edge_padded_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.edge_slice(F.col("embedding"), -3, 70).alias("v"))


def mixup_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector: the chosen ones with their halves mixed, the others cropped to the first half."""
    mixed = F.col("label") < 5
    v = F.when(mixed, vectors.mixed_halves(F.col("embedding"), 32)).otherwise(F.slice("embedding", 1, 32))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(mixed, F.lit(False)).alias("mixed"), v.alias("v"))


def word_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn against itself without the letter e, by role."""
    rows = table(spark, sf_dir, "conversations").select("role", "text", F.regexp_replace("text", "e", "").alias("heard"))
    return score.word_errors(rows, "text", "heard").groupBy("role").agg(F.sum("errors").alias("errors"), F.sum("length").alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        feature_mean_std, channelwise_mean_std, merged_moments, domain_adapt_mean_std, domain_adapt_mean_scale, domain_adapt_mean, lower_median_channels, value_profile,
        error_rate_rollup, average_of_reference_keys, leave_one_out_sum, inverted_index, nested_example_build, explode_back, channel_explode, bcast_channels, retention_guard,
        duplicate_keys, min_length_sort, speaker_set_consistency, key_fallback_join, prefix_offset_join, source_lookup_inner_anti, kaldi_tables_join, union_datasets,
        set_difference, disjoint_check, distinct_file_udf, id_canonicalise, transcript_normalise, json_path_access, mulaw_quantise, upsample_repeat, edge_padded_slice,
        mixup_halves, word_error_counts,
    )
}

_DIMS = "SELECT vec_id, label, unnest(generate_series(0, 63)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings"
_ADAPT = lambda scale: f"""WITH d AS ({_DIMS}), e AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM d WHERE label < 5 GROUP BY dim), v AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM d WHERE label >= 5 GROUP BY dim)
SELECT vec_id, list(round((x - e.m) * {scale} + v.m, 6) ORDER BY dim) AS embedding FROM d JOIN e USING (dim) JOIN v USING (dim) WHERE label < 5 GROUP BY vec_id"""  # noqa: E731
_NAMES = """names AS (
  SELECT page_id, 0 AS form, 'overlap_ratio_' || (page_id % 5 * 10) || '.0_sil0.1_0.5_session' || page_id || '_actual9.9' AS name FROM pages UNION ALL
  SELECT page_id, 1, 'session' || page_id || '_0L' FROM pages UNION ALL SELECT page_id, 2, 'OV20_session' || page_id FROM pages UNION ALL
  SELECT page_id, 3, '1089_session' || page_id || '_CH3_0S_003830_004658' FROM pages UNION ALL SELECT page_id, 4, url FROM pages)"""

ORACLE_SQL = {
    "feature_mean_std": f"WITH d AS ({_DIMS}) SELECT CAST(dim AS INT) AS dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, count(*) AS n FROM d GROUP BY dim",
    "channelwise_mean_std": f"WITH d AS ({_DIMS}) SELECT label, CAST(dim AS INT) AS dim, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, count(*) AS n FROM d GROUP BY label, dim",
    "merged_moments": "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY ALL",
    "domain_adapt_mean_std": _ADAPT("(v.s / e.s)"),
    "domain_adapt_mean_scale": _ADAPT("((SELECT avg(s) FROM v) / (SELECT avg(s) FROM e))"),
    "domain_adapt_mean": _ADAPT("1.0"),
    "lower_median_channels": "SELECT l_returnflag, l_linestatus, quantile_disc(l_quantity, 0.5) AS median FROM lineitem GROUP BY ALL",
    "value_profile": "SELECT event_type, count(*) AS size, count_if(isnan(value))::BIGINT AS n_nan, count_if(isinf(value))::BIGINT AS n_inf, count_if(isfinite(value))::BIGINT AS n_finite, min(value) AS low, quantile_cont(value, 0.5) AS median, max(value) AS high FROM events GROUP BY event_type",
    "error_rate_rollup": """WITH r AS (SELECT l_linestatus, CAST(year(l_shipdate) AS INT) AS year, l_returnflag, CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END AS errors, CAST(l_quantity AS BIGINT) AS length FROM lineitem)
SELECT l_linestatus, year, l_returnflag, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(length) AS BIGINT) AS length, round(CAST(sum(errors) AS DOUBLE) / CAST(sum(length) AS DOUBLE), 9) AS error_rate FROM r
GROUP BY GROUPING SETS ((l_linestatus, year, l_returnflag), (l_linestatus, year), (l_linestatus), ())""",
    "average_of_reference_keys": """WITH r AS (SELECT event_type, CAST(hour(ts) AS INT) AS hour, CASE WHEN value > 10 THEN 1 ELSE 0 END AS errors FROM events), k AS (SELECT * FROM r WHERE hour IN (SELECT hour FROM r WHERE event_type = 'error'))
SELECT hour, CAST(sum(errors) AS BIGINT) AS errors, count(*) AS length, round(CAST(sum(errors) AS DOUBLE) / CAST(count(*) AS DOUBLE), 9) AS error_rate FROM k GROUP BY GROUPING SETS ((hour), ())""",
    "leave_one_out_sum": "WITH r AS (SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) SELECT *, CAST(sum(cents) OVER (PARTITION BY o_custkey) - cents AS BIGINT) AS others FROM r",
    "inverted_index": "SELECT o_custkey, list(DISTINCT o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_custkey",
    "nested_example_build": "SELECT conv_id, list(turn ORDER BY turn, role, length(text)) AS turn, list(role ORDER BY turn, role, length(text)) AS role, list(length(text) ORDER BY turn, role, length(text)) AS n FROM conversations GROUP BY conv_id",
    "explode_back": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, length(text)) - 1 AS INT) AS ord, turn, role, length(text) AS n FROM conversations",
    "channel_explode": "SELECT p_partkey || '_U0' || (c + 1) || 'CH' || c AS example_id, '/audio/' || p_brand || '/U0' || (c + 1) || '.CH' || c || '.wav' AS file, CAST(p_partkey AS VARCHAR) AS parent FROM part, (VALUES (0), (1), (2)) AS v(c)",
    "bcast_channels": "SELECT vec_id || '_ch' || c AS key, label, CAST(c AS INT) AS channel FROM embeddings, generate_series(0, 6) AS v(c)",
    "retention_guard": "SELECT count(*) AS n, count_if(coalesce(quality, 1) = 1)::BIGINT AS n_kept, count_if(coalesce(quality, 1) = 1) > floor(count(*) / 3) AS enough FROM documents LEFT JOIN labels USING (doc_id)",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "min_length_sort": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS session, event_id, value FROM events WHERE value >= 5",
    "speaker_set_consistency": """SELECT o_custkey, list_sort(a) = list_sort(b) AS same FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS a FROM orders GROUP BY o_custkey)
JOIN (SELECT o_custkey, list(DISTINCT l_linestatus) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey) USING (o_custkey)""",
    "key_fallback_join": """WITH k AS (SELECT n_name AS key FROM nation UNION ALL SELECT n_name || '_ch1' FROM nation UNION ALL SELECT n_name || '_x' FROM nation)
SELECT k.key, coalesce(a.n_regionkey, b.n_regionkey) AS n_regionkey FROM k LEFT JOIN nation a ON a.n_name = k.key LEFT JOIN nation b ON b.n_name = regexp_replace(k.key, '_ch.$', '')""",
    "prefix_offset_join": """WITH p AS (SELECT p_brand AS key, min(p_size) AS value FROM part GROUP BY p_brand), k AS (SELECT key FROM p UNION SELECT substr(key, 1, 5) FROM p UNION SELECT substr(key, 1, 7) FROM p),
m AS (SELECT k.key, max(CASE WHEN p.key = k.key THEN value END) AS exact, min(value) AS a, max(value) AS b FROM k LEFT JOIN p ON starts_with(p.key, k.key) GROUP BY k.key) SELECT key, coalesce(exact, CASE WHEN a = b THEN a END) AS value FROM m""",
    "source_lookup_inner_anti": """SELECT c_mktsegment, count_if(c_custkey IN (SELECT o_custkey FROM orders))::BIGINT AS n_found, count_if(c_custkey NOT IN (SELECT o_custkey FROM orders))::BIGINT AS n_missed FROM customer GROUP BY c_mktsegment""",
    "kaldi_tables_join": "SELECT conv_id || '-' || role AS key, min(turn) AS turn, min_by(length(text), turn) AS n FROM conversations GROUP BY conv_id, role",
    "union_datasets": """SELECT dataset, labelled, count(*) AS n, max(id) AS last FROM (SELECT 'documents' AS dataset, doc_id AS id, CAST(NULL AS BOOLEAN) AS labelled FROM documents UNION ALL SELECT 'labels', doc_id, true FROM labels UNION ALL SELECT 'pages', page_id, NULL FROM pages) GROUP BY ALL""",
    "set_difference": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "disjoint_check": "SELECT count(*) AS n_shared FROM (SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 1)",
    "distinct_file_udf": "SELECT doc_id, source, 'text of ' || source AS words FROM documents",
    "id_canonicalise": f"""WITH {_NAMES} SELECT page_id, CAST(form AS INT) AS form,
  CASE form WHEN 0 THEN CASE WHEN page_id % 5 = 0 THEN 'session' || page_id || '_CH0_0S' END WHEN 1 THEN 'session' || page_id || '_CH0_0L' WHEN 2 THEN 'session' || page_id || '_CH0_OV20' END AS canonical,
  CASE WHEN contains(name, 'session0') THEN 'dev' ELSE 'eval' END AS split, regexp_replace(name, '[^a-zA-Z0-9]', '_', 'g') AS safe, regexp_replace(name, '_[^_]*$', '') AS stem, CASE WHEN page_id < 10000 THEN lpad(CAST(page_id AS VARCHAR), 4, '0') ELSE CAST(page_id AS VARCHAR) END AS number FROM names""",
    "transcript_normalise": """SELECT conv_id, turn, nullif(trim(translate(text, '-?,.!', ' ')), '') AS cleaned, trim(regexp_replace(regexp_replace(text, '[^ -~\n]', 'x', 'g'), '\\s+', ' ', 'g')) AS squashed,
  upper(regexp_replace(text, '[^ -~]', 'x', 'g')) AS words, regexp_replace(text, '[^ -~]', 'x', 'g') AS words_orig, translate(lower(regexp_replace(text, '[^ -~]', 'x', 'g')), '.?!,', '') AS scored FROM conversations""",
    "json_path_access": "WITH k AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, k AS first, k + 2 AS last, [k, k + 1] AS two, [k + 2, k + 1, k] AS back FROM k",
    "mulaw_quantise": """WITH x AS (SELECT event_id, (event_id % 1000)::DOUBLE / 999.0::DOUBLE AS x FROM events), q AS (SELECT event_id, CAST(round_even(255.0::DOUBLE * ln(1 + 255.0::DOUBLE * x) / ln(256.0::DOUBLE), 0) AS INT) AS q, CAST(round_even(255.0::DOUBLE * x, 0) AS INT) AS linear FROM x)
SELECT event_id, q, round((pow(256.0::DOUBLE, q / 255.0::DOUBLE) - 1) / 255.0::DOUBLE, 9) AS back, linear FROM q""",
    "upsample_repeat": "SELECT vec_id, list_transform(generate_series(0, 249), lambda i: embedding[CAST(floor(i / 4) AS INT) + 1]) AS v FROM embeddings",
    "edge_padded_slice": "SELECT vec_id, list_transform(generate_series(-3, 69), lambda i: embedding[CAST(least(greatest(i, 0), 63) AS INT) + 1]) AS v FROM embeddings",
    "mixup_halves": "SELECT vec_id, coalesce(label < 5, false) AS mixed, CASE WHEN label < 5 THEN list_transform(generate_series(1, 32), lambda i: embedding[CAST(i AS INT)] + embedding[CAST(i AS INT) + 32]) ELSE embedding[1:32] END AS v FROM embeddings",
}
