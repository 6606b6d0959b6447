"""Operator 8, quality rules: a ledger of rule bits, versioned policies and ablations.

Every rule is evaluated once over a document's measurements. The ledger keeps the measurements
and one bitmask of failures; a policy is a named set of bits that reject, so another policy or
an ablation needs bit operations on the ledger alone, never the text again. Everything is a
built-in expression in one projection: no shuffle, no Python.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows are
judged alike, each for itself; an empty table gives an empty ledger; columns other than the id
and the text are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL predicate over the measurements."""

    name: str
    fails: str


#: The order gives the bits; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 14 * n_words"),
)

#: The rules that reject, by version of the policy.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def bits(names: tuple[str, ...] | list[str]) -> int:
    """The mask of the named rules."""
    place = {r.name: i for i, r in enumerate(RULES)}
    return sum(1 << place[n] for n in names)


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def placed_copies(windows: Column) -> Column:
    """Hash and place of each 3-word window, sorted; null where no window repeats.

    Most texts repeat none and stop here. For the others, copies stand side by side.
    """
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), placed)


def copied_places(placed: Column) -> Column:
    """The sorted places of the windows that stand beside a copy."""
    copied = lambda x, k: (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"])
    places = F.transform(placed, lambda x, k: F.when(copied(x, k), x["i"]))
    return F.sort_array(F.filter(places, lambda i: i.isNotNull()))


def covered_words(places: Column) -> Column:
    """Words under 3-word windows at these places: 3 each, less what the next one covers too."""
    words = lambda i, k: F.least(F.coalesce(F.get(places, k + 1) - i, F.lit(3)), F.lit(3))
    return F.coalesce(F.aggregate(F.transform(places, words), F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0).cast("bigint"))


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, *keep``, the measurements and ``failures``, the bitmask of failed rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), *keep, text.alias("_text"))
    rows = rows.select(id_col, *keep, "_text", words_of(F.col("_text")).alias("_words"))
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    rows = rows.select(
        id_col,
        *keep,
        "_text",
        "_words",
        F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).alias("_windows"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    # A column for each step: what a lambda refers to is looked up there, not computed again.
    rows = rows.withColumn("_placed", placed_copies(F.col("_windows"))).withColumn("_places", copied_places(F.col("_placed")))
    squeezed = F.regexp_replace("_text", f"{SPACE}+", "")
    rows = rows.select(
        id_col,
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(squeezed).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        covered_words(F.col("_places")).alias("n_repeat_words"),
    )
    mask = F.lit(0).cast("bigint")
    for i, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return rows.withColumn("failures", mask)


def passes(failures: Column, policy: str = "v1") -> Column:
    """Whether a ledger's mask passes the policy."""
    return failures.bitwiseAND(F.lit(bits(POLICIES[policy])).cast("bigint")) == 0


def passing(docs: DataFrame, policy: str = "v1", **columns) -> DataFrame:
    """The rows of ledger(docs, **columns) that pass the policy.

    The row number keeps the filter above the ledger: below it, the optimiser would write every
    measurement out again inside the condition, and inside each other's lambdas.
    """
    rows = ledger(docs, **columns).withColumn("_at", F.monotonically_increasing_id())
    return rows.where(passes(F.col("failures"), policy) & (F.col("_at") >= 0)).drop("_at")


def ablations(ledger_rows: DataFrame, policy: str = "v1") -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that fail it alone and so
    would come back without it, and that the policy keeps. One aggregate of a row a rule.
    """
    mask = bits(POLICIES[policy])
    failed = F.col("failures").bitwiseAND(F.lit(mask).cast("bigint"))
    names = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bits([n])).cast("bigint").alias("bit")) for n in POLICIES[policy]])
    counted = ledger_rows.groupBy(failed.alias("failed")).agg(F.count(F.lit(1)).alias("n"))
    each = counted.select("failed", "n", F.explode(names).alias("r")).select("failed", "n", "r.rule", "r.bit")
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("bigint")
    return each.groupBy("rule").agg(
        total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("failed") == F.col("bit")).alias("n_only"),
        total(F.col("failed") == 0).alias("n_kept"),
    )
