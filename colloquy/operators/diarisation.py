"""Scores of who spoke when, and of who said what, under the best assignment of speakers.

Time is cut into slices, and every join and window is within a slice, so that a long session is
not one task's; only sums for pairs of speakers are gathered for each session.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import assignment, intervals, score

Keys = list[str]


def sliced(spans: DataFrame, width: int) -> DataFrame:
    """Spans ``..., s, e`` cut at the multiples of ``width``, with the number of the ``slice``."""
    first, last = F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)
    rows = spans.where("s < e").withColumn("slice", F.explode(F.sequence(first, last)))
    return rows.withColumns({"s": F.greatest("s", F.col("slice") * width), "e": F.least("e", (F.col("slice") + 1) * width)})


def _elementary(cut: list[DataFrame], keys: Keys) -> DataFrame:
    """``*keys, slice, s, e`` between neighbouring ends of spans of a slice."""
    edges = reduce(DataFrame.union, [c.select(*keys, "slice", F.col(at).alias("s")) for c in cut for at in ("s", "e")]).distinct()
    by = Window.partitionBy(*keys, "slice").orderBy("s")
    return edges.withColumn("e", F.lead("s").over(by)).where("e IS NOT NULL")


def _active(parts: DataFrame, cut: DataFrame, keys: Keys, *columns: str) -> DataFrame:
    """``*keys, slice, s, e, *columns``: the elementary parts within spans."""
    spans = cut.select(*keys, "slice", F.col("s").alias("_s"), F.col("e").alias("_e"), *columns)
    return parts.join(spans, [*keys, "slice"]).where("_s <= s AND e <= _e").drop("_s", "_e")


def error_times(reference: DataFrame, hypothesis: DataFrame, keys: Keys, speaker: str, *, collar: int = 0, width: int) -> DataFrame:
    """``*keys, total, missed, false_alarm, confusion, der`` of spans ``*keys, speaker, s, e``.

    ``collar`` is the length, half before and half after, that isn't scored around each end of a
    reference span. Time counts for each speaker. Spans of one speaker that overlap are united, and a
    session that is only in one table counts whole. der is null without reference time.
    ``width`` is the length of a slice: pairs are made within one only.
    """
    ref, hyp = (intervals.union(x, [*keys, speaker]) for x in (reference, hypothesis))
    ends = ref.select(*keys, F.col("s").alias("t")).union(ref.select(*keys, F.col("e").alias("t")))
    unscored = intervals.union(ends.select(*keys, (F.col("t") - collar // 2).alias("s"), (F.col("t") + collar // 2).alias("e")).where("s < e"), keys)
    cut_ref, cut_hyp, cut_out = sliced(ref, width), sliced(hyp, width), sliced(unscored, width)
    parts = _elementary([cut_ref, cut_hyp, cut_out], keys)
    part = [*keys, "slice", "s", "e"]
    parts = parts.join(_active(parts, cut_out, keys).distinct(), part, "left_anti")
    in_ref = _active(parts, cut_ref, keys, speaker).withColumnRenamed(speaker, "a")
    in_hyp = _active(parts, cut_hyp, keys, speaker).withColumnRenamed(speaker, "b")
    n = lambda rows, name: rows.groupBy(*part).agg(F.count(F.lit(1)).alias(name))
    counts = n(in_ref, "n").join(n(in_hyp, "m"), part, "full").withColumns({"n": F.coalesce("n", F.lit(0)), "m": F.coalesce("m", F.lit(0))})
    time = F.col("e") - F.col("s")
    sums = counts.groupBy(*keys).agg(
        F.sum(time * F.col("n")).alias("total"),
        F.sum(time * F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("missed"),
        F.sum(time * F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("false_alarm"),
        F.sum(time * F.least("n", "m")).alias("_both"),
    )
    together = in_ref.join(in_hyp, part).groupBy(*keys, "a", "b").agg(F.sum(-time).alias("v"))
    pairs = together.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "v")).alias("_pairs"))
    alone = lambda rows, x, name: rows.select(*keys, x).distinct().groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("k"), F.lit(0).cast("bigint").alias("v"))).alias(name))
    sums = sums.join(pairs, keys, "left").join(alone(in_ref, "a", "_a"), keys, "left").join(alone(in_hyp, "b", "_b"), keys, "left")
    matched = -assignment.least_totals(F.col("_pairs"), F.col("_a"), F.col("_b"))
    sums = sums.withColumn("confusion", F.col("_both") - matched)
    rate = (F.col("missed") + F.col("false_alarm") + F.col("confusion")) / F.nullif("total", F.lit(0))
    return sums.select(*keys, "total", "missed", "false_alarm", "confusion", rate.alias("der"))


def word_errors_of_sessions(reference: DataFrame, hypothesis: DataFrame, keys: Keys, speaker: str, order: list[str], text: str) -> DataFrame:
    """``*keys, errors, length, error_rate``: word errors of each session when every speaker's words
    stand in one line, under the assignment of speakers with the fewest errors (cpWER).

    ``order`` sorts a speaker's rows. A speaker without partner counts with all words. A speaker's
    line of a session is one row, and each pair of two speakers of a session is compared by itself.
    """
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.coalesce(text, F.lit("")).alias("_t")))), lambda x: x["_t"]), " ")
    lines = lambda rows, k, t: rows.groupBy(*keys, F.col(speaker).alias(k)).agg(said.alias(t))
    ref, hyp = lines(reference, "a", "_ref"), lines(hypothesis, "b", "_hyp")
    scored = score.word_errors(ref.join(hyp, keys), "_ref", "_hyp")
    pairs = scored.groupBy(*keys).agg(F.collect_list(F.struct("a", "b", F.col("errors").alias("v"))).alias("_pairs"))
    words = lambda t: F.regexp_count(t, F.lit(r"\S+")).cast("bigint")
    alone = lambda rows, x, t, name: rows.groupBy(*keys).agg(F.collect_list(F.struct(F.col(x).alias("k"), words(t).alias("v"))).alias(name), F.sum(words(t)).alias(f"{name}_n"))
    rows = alone(ref, "a", "_ref", "_a").join(alone(hyp, "b", "_hyp", "_b"), keys, "full").join(pairs, keys, "left")
    rows = rows.withColumn("errors", assignment.least_totals(F.col("_pairs"), F.col("_a"), F.col("_b"))).withColumn("length", F.coalesce("_a_n", F.lit(0)))
    return rows.select(*keys, "errors", "length", (F.col("errors") / F.nullif("length", F.lit(0))).alias("error_rate"))
