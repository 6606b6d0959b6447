"""Queries of the operators that fit or draw from whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, language, resampling, toxicity
from .tables import table


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))[0]


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (language.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op11_centroid_clustering, op12_importance_resampling, op13_toxicity)}


def _clustering_sql(dims: int = 64, scale: int = 1024, clusters: int = 8, rounds: int = 10, salt: str = "3") -> str:
    """Rounds as a chain: a0 assigns to the first centroids, c1 are the means of a0, and so on."""
    nearest = "SELECT vec_id, v, cluster, d FROM (SELECT x.row, x.vec_id, x.v, c.cluster, list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept x, c{k} c) QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, cluster) = 1"
    mean = "((s - ((s % n) + n) % n) // n)::BIGINT"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({nearest.format(k=k)})")
        if k < rounds:
            steps.append(f"""c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT cluster, list({mean} ORDER BY i) AS v FROM (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, generate_series(1, {dims}) AS g(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS cluster, v FROM (SELECT sha256('{salt}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {clusters})),
{", ".join(steps)}
SELECT vec_id, cluster::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(list_aggregate(c.v, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (cluster)"""


def _resampling_sql(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    steps = "list_reduce([b::BIGINT] || range(8), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH crc_table AS (SELECT list({steps} ORDER BY b) AS t FROM range(256) AS r(b)),
dw AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
bw AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
each AS MATERIALIZED (SELECT row, unnest(w) AS f FROM dw),
different AS (SELECT DISTINCT f FROM (SELECT f FROM each UNION ALL SELECT unnest(w) FROM bw)),
hashed AS MATERIALIZED (
  SELECT f, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::BIGINT, 2))::BIGINT),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % {buckets} AS b FROM different, crc_table),
corpus AS MATERIALIZED (SELECT b, count(*) AS n FROM each JOIN hashed USING (f) GROUP BY b),
target AS MATERIALIZED (SELECT b, count(*) AS n FROM (SELECT unnest(w) AS f FROM bw) JOIN hashed USING (f) GROUP BY b),
totals AS (SELECT coalesce((SELECT sum(n) FROM corpus), 0)::DOUBLE AS s, coalesce((SELECT sum(n) FROM target), 0)::DOUBLE AS t),
gain AS MATERIALIZED (
  SELECT corpus.b, floor(1000 * ln((coalesce(target.n, 0)::DOUBLE + 1) * (s + {buckets}) / ((corpus.n::DOUBLE + 1) * (t + {buckets}))))::BIGINT AS g
  FROM corpus LEFT JOIN target USING (b), totals),
weights AS (SELECT row, sum(g)::BIGINT AS weight FROM each JOIN hashed USING (f) JOIN gain USING (b) GROUP BY row),
scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM dw LEFT JOIN weights USING (row)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= {least_words} ORDER BY score DESC, doc_id, n_features) AS place, count(*) OVER (PARTITION BY n_features >= {least_words}) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {least_words} AND place <= {percent} * n // 100 THEN place END::BIGINT AS rank FROM placed"""


ORACLE_SQL = {"op11_centroid_clustering": _clustering_sql(), "op12_importance_resampling": _resampling_sql()}
