"""The corpus pipeline: raw documents in, packed sequences out.

Each stage applies one operator to all rows that its predecessor kept. Stages that filter or
clean return the columns of their input, whatever those are; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import jaccard_join, language, packing, quality, substring_dedup
from colloquy.llm.tables import discard, table, written

#: Documents whose language is less certain than this go.
MIN_SCORE = 0.5
#: No SQL can express the language model, the passages or the packing.
ORACLE_SQL = None


def _whole_rows(docs: DataFrame) -> DataFrame:
    """Id, text and the whole row as one column, so that no other name can clash."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the policy v1 of the quality rules. A null text has no words and goes."""
    return quality.passing(_whole_rows(docs), "v1", keep=("_row",)).select("_row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model, fitted on these documents, is certain of.

    Without labelled documents there is no model; then only texts without a letter go.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows = language.identify(_whole_rows(docs), model, keep=("_row",))
    return rows.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at 0.8 or more: that of the smallest id.

    Rows of one id with different texts are documents of their own; of equal rows one stays.
    Documents without words are groups of their own, and those without an id can't be grouped:
    all of them stay.
    """
    groups = written(jaccard_join.similar(docs, width=5, num=80, den=100).where("first AND doc_id IS NOT NULL").groupBy("doc_id", "text_hash").count())
    rows = _whole_rows(docs).withColumn("text_hash", F.xxhash64("text")).join(groups, ["doc_id", "text_hash"])
    if groups.where("count > 1").limit(1).count():
        again = rows.where("count > 1").groupBy("doc_id", "text_hash").agg(F.first("_row").alias("_row"))
        rows = rows.where("count = 1").select("_row").unionByName(again.select("_row"))
    return rows.select("_row.*").unionByName(docs.where("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier one has; n_chars follows the text.

    A document goes when nothing but repeated passages was in it, or no word at all. Rows without an
    id stay as they are; rows of one id with different texts lose what was found in each.
    """
    found = written(substring_dedup.repeats(docs))
    cut = substring_dedup.without_repeats(docs, found)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 2048 tokens."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each one's result written before the next.

    What the result reads stays in the shared folder; ``clear`` of colloquy.llm.tables deletes it.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        done = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            done = written(done)
            if k:
                discard(docs)
        docs = done
    return docs
