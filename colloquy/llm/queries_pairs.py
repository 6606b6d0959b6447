"""Queries of the operators that compare texts with each other, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, substring_dedup
from .tables import table


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"), width=3, num=90, den=100).drop("text_hash", "first")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each verified passage: where it is, and the earlier passage that it repeats."""
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    words = lambda name: F.col(name).cast("bigint").alias(f"{name}_word")
    return found.select(F.col("id").alias("doc_id"), words("first"), words("last"), F.col("source_id").alias("source_doc_id"), words("source_first"), words("source_last"))


QUERIES = {f.__name__: f for f in (op4_ngram_jaccard_join, op9_substring_dedup)}
ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 90 * (x.n + y.n - n_both)),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.node)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(node) AS component_id, any_value(set_id) AS set_id
FROM reach LEFT JOIN sizes USING (doc_id)
LEFT JOIN (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS set_id FROM (SELECT doc_id, list_sort(list(s)) AS h FROM shingles GROUP BY doc_id)) USING (doc_id)
GROUP BY doc_id""",
}
