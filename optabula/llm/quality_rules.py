"""Quality rules: a table of thresholds, compiled into projections of native expressions.

The measures of a text are column expressions over its words and lines; a rule bounds one measure
from below and above. Measures that several rules share are named once, so that a text is split
into words and lines once, and no user function runs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CLASS, texts, words

# Frequent short words of English, German, French and Spanish.
STOP_WORDS = [
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "are", "was", "in", "it", "for",
    "on", "as", "by", "this", "at", "from", "or", "an", "a",
    "der", "die", "das", "den", "dem", "des", "und", "ist", "mit", "von", "zu", "auf", "für",
    "ein", "eine", "einer", "als", "auch", "im", "nicht",
    "le", "la", "les", "de", "du", "et", "en", "un", "une", "que", "qui", "est", "pour", "pas",
    "dans", "sur", "par", "au",
    "el", "los", "las", "del", "y", "se", "con", "no", "su", "lo", "para", "al",
]
# The symbols of the symbol ratio, and how bullet and cut-off lines look.
SYMBOLS = "[#*$%&|<>]"
BULLET_LINE = "^[ \\t]*[-*\\u2022]"
CUT_LINE = "(\\.\\.\\.|\\u2026)[ \\t\\r]*$"
WINDOW = 5


class Rule(NamedTuple):
    """`low <= measure <= high` for texts of at least `from_words` words; None bounds nothing."""

    measure: str
    low: float | None
    high: float | None
    from_words: int = 0


RULES = [
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 2.0, 20.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.02, None, 50),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("cut_line_share", None, 0.3),
]


def compiled(rules: list[Rule]) -> Column:
    """The rules as one boolean column over the measures."""
    verdict = F.lit(True)
    for rule in rules:
        value, held = F.col(rule.measure), F.lit(True)
        if rule.low is not None:
            held &= value >= F.lit(rule.low)
        if rule.high is not None:
            held &= value <= F.lit(rule.high)
        verdict &= held | (F.col("n_words") < rule.from_words)
    return verdict


def _window_hashes() -> Column:
    """A hash for each window of WINDOW consecutive words; words are hashed in turn, not joined."""
    n = F.greatest(F.size("w") - (WINDOW - 1), F.lit(0))
    shifted = [F.slice("w", F.lit(k + 1), n).alias(f"w{k}") for k in range(WINDOW)]
    return F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(s))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and all measures. Shares of nothing are 0."""
    has_word = f"[^{WHITE_CLASS[1:]}"
    split = texts(docs).select(
        "doc_id",
        words().alias("w"),
        F.length(F.regexp_replace("text", f"{WHITE_CLASS}+", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(has_word)).alias("lines"))
    hashed = split.select(
        "*", F.size("w").cast("long").alias("n_words"), F.size("lines").alias("n_lines"),
        _window_hashes().alias("h"))
    # Texts in which a window comes twice are few: only they are sorted.
    repeats = hashed.select("*", F.when(
        F.size(F.array_distinct("h")) < F.size("h"),
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))

    def twice(x, j):
        s = F.col("s")
        return (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])

    starts = repeats.select("*", F.sort_array(F.transform(F.filter(
        "s", lambda x, j: F.coalesce(twice(x, j), F.lit(False))), lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform("starts", lambda x, j: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), j + 1) - x, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x)

    def share(part: Column, whole: str) -> Column:
        return F.when(F.col(whole) > 0, part / F.col(whole)).otherwise(F.lit(0.0))

    def lines_like(pattern: str) -> Column:
        return F.size(F.filter("lines", lambda x: x.rlike(pattern)))

    dup_lines = (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long")
    counted = starts.select(
        "doc_id", "n_words", "n_lines", "word_chars", "n_symbols", dup_lines.alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        share(F.size(F.filter("w", lambda x: x.isin(STOP_WORDS))), "n_words").alias("stop_word_share"),
        share(lines_like(BULLET_LINE), "n_lines").alias("bullet_line_share"),
        share(lines_like(CUT_LINE), "n_lines").alias("cut_line_share"))
    return counted.select(
        "*", share(F.col("word_chars"), "n_words").alias("mean_word_chars"),
        share(F.col("n_symbols"), "n_words").alias("symbols_per_word"),
        share(F.col("n_dup_lines"), "n_lines").alias("dup_line_share"))


def quality_rules(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per document: its measures, `base_failed` and `kept`.

    `base_failed`: fewer than 10 words, or over a fifth of the words in windows that come twice.
    `kept`: not `base_failed`, and every rule holds. A null or empty text has no words and fails;
    null doc_ids stay null; repeated rows are judged each; an empty table gives no rows; other
    columns are ignored.
    """
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured(docs).withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & compiled(rules))
