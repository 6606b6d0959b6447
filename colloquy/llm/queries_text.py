"""Queries of the operators that look at one text at a time, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, language, licenses, packed_matrices, packing, quality, sentencepieces
from .tables import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.count_tokens(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentencepieces.encode_and_decode(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", (language.fold("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next(table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text")))
    rows = rows.withColumn("_words", quality.words_of(F.col("edited")))
    rows = rows.withColumn("edited_sketch", fingerprints.sketch_of(F.col("_words")))
    own = F.col("sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_text(own).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(own, F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(own, F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(own).alias("n_shingles_est"),
        fingerprints.containment(own, F.col("edited_sketch")).alias("contained_in_edited"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.passes(rows["failures"], "base")
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "failures"]
    return rows.select(*columns, base.alias("base_failed"), quality.passes(rows["failures"], "v1").alias("kept"))


def op10_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packed_matrices.matrices(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_ids",
        "starts",
        "cu_seqlens",
        F.col("n_tokens").cast("bigint").alias("n_tokens"),
        F.crc32("input_ids").alias("input_ids_crc32"),
        F.crc32("position_ids").alias("position_ids_crc32"),
    )


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_token_counts, op3_sentencepiece, op5_language_id, op6_best_fit_packing, op7_fingerprints, op8_quality_rules, op10_packed_matrices)}


def _license_sql() -> str:
    values = ", ".join(f"('{name}', '{a} {b}')" for name, text in sorted(licenses.KNOWN.items()) for a, b in licenses.template_bigrams(text))
    places = ", ".join(f"('{name}', {before}, '{phrase}', {after})" for name, text in sorted(licenses.KNOWN.items()) for before, phrase, after in licenses.anchors(text))
    clean = "lower(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g')))"
    return f"""
WITH grams(name, gram) AS (VALUES {values}),
sizes AS (SELECT name, count(*) AS n FROM grams GROUP BY name),
units AS (
  SELECT doc_id, 'l' || k AS unit, {clean.format("lines[k]")} AS x, 1 AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(generate_series(1, len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL)
  UNION ALL
  SELECT doc_id, 'b' || k, {clean.format("blocks[k]")}, 0
  FROM (SELECT doc_id, string_split_regex(text, '\\n\\s*\\n') AS blocks, unnest(generate_series(1, len(string_split_regex(text, '\\n\\s*\\n')))) AS k FROM documents WHERE regexp_matches(text, '\\n\\s*\\n'))
  UNION ALL
  SELECT doc_id, 'w', {clean.format("text")}, 0 FROM documents WHERE contains(text, chr(10))
),
words AS (SELECT doc_id, unit, line, string_split(x, ' ') AS w FROM units),
pairs AS (SELECT DISTINCT doc_id, unit, line, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM words)),
counted AS (SELECT doc_id, unit, line, count(*) AS n FROM pairs GROUP BY ALL),
shared AS (SELECT doc_id, unit, name, count(*) AS n_both FROM pairs JOIN grams USING (gram) GROUP BY ALL),
scored AS (SELECT doc_id, unit, line, name, 2.0::DOUBLE * n_both / (counted.n + sizes.n) AS dice FROM shared JOIN counted USING (doc_id, unit) JOIN sizes USING (name)),
anchors(name, before, phrase, after) AS (VALUES {places}),
padded AS (SELECT doc_id, ' ' || {clean.format("text")} || ' ' AS x FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, anchors.*, string_split(x, ' ' || phrase || ' ') AS p FROM padded JOIN anchors ON contains(x, ' ' || phrase || ' ')),
sides AS (SELECT *, list_filter(string_split(p[k], ' '), lambda y: y <> '') AS a, list_filter(string_split(p[k + 1], ' '), lambda y: y <> '') AS b FROM (SELECT *, unnest(generate_series(1, len(p) - 1)) AS k FROM cut)),
runs AS (SELECT doc_id, name, before, k, list_concat(list_concat(a[greatest(len(a) - before + 1, 1):len(a)], string_split(phrase, ' ')), b[1:after]) AS w FROM sides),
run_pairs AS (SELECT DISTINCT doc_id, name, before, k, w[i] || ' ' || w[i + 1] AS gram FROM (SELECT *, unnest(generate_series(1, len(w) - 1)) AS i FROM runs)),
run_counts AS (SELECT doc_id, name, before, k, count(*) AS n, count(grams.gram) AS n_both FROM run_pairs LEFT JOIN grams USING (name, gram) GROUP BY ALL),
run_hits AS (SELECT doc_id, name, max(2.0::DOUBLE * n_both / (run_counts.n + sizes.n)) AS dice FROM run_counts JOIN sizes USING (name) GROUP BY doc_id, name HAVING max(2.0::DOUBLE * n_both / (run_counts.n + sizes.n)) >= {licenses.THRESHOLD}::DOUBLE),
hits AS (SELECT * FROM scored WHERE dice >= {licenses.THRESHOLD}::DOUBLE),
both_hits AS (SELECT doc_id, name, dice FROM hits UNION ALL SELECT doc_id, name, dice FROM run_hits),
best AS (SELECT doc_id, name, dice FROM both_hits JOIN sizes USING (name) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, n DESC, name) = 1),
lines AS (SELECT doc_id, count(DISTINCT unit) AS n_notices FROM hits WHERE line = 1 GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT regexp_replace(name, ' (notice|text)$', '')) AS n_runs FROM run_hits GROUP BY doc_id)
SELECT d.doc_id, best.name AS license, coalesce(best.dice, 0.0::DOUBLE) AS dice, coalesce(n_notices, 0)::BIGINT AS n_notices,
  regexp_replace(best.name, ' (notice|text)$', '') AS family, coalesce(n_runs, 0)::BIGINT AS n_runs
FROM documents d LEFT JOIN best USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _quality_sql() -> str:
    failures = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(quality.RULES))
    mask = lambda p: quality.bits(quality.POLICIES[p])
    return rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (
  SELECT split.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, ({failures})::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, failures, (failures & {mask("base")}) <> 0 AS base_failed, (failures & {mask("v1")}) = 0 AS kept FROM f"""


ORACLE_SQL = {"op1_license_scan": _license_sql(), "op8_quality_rules": _quality_sql()}
