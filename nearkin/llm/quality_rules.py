"""Quality rules: a table of thresholds compiled into one Spark projection.

Everything is built-in functions; no Python runs on the executors. The projection is laid out in a
few ``select`` steps so that Spark evaluates each word array once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import SPACE, as_row, from_row

SYMBOLS = "#*$%&|<>"
WINDOW = 5
# Frequent words of the languages at hand; running text of some length has several.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with they be at one have this from or by but not what all were when".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se il avec ce son".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ya".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document fails if ``value``, or its ratio to ``per``, leaves [low, high].

    ``value`` is an SQL expression over the statistics, ``per`` one of them; a ratio to zero fails nothing.
    """

    name: str
    value: str
    per: str | None = None
    low: float | None = None
    high: float | None = None

    def fails(self) -> Column:
        value, failed = F.expr(self.value), F.lit(False)
        if self.per:
            value = F.try_divide(value, F.col(self.per))
        if self.low is not None:
            failed = failed | (value < self.low)
        if self.high is not None:
            failed = failed | (value > self.high)
        return F.coalesce(failed, F.lit(False))


# What every document must pass before the ratios are looked at.
BASE = (
    Rule("words", "n_words", low=10),
    Rule("repeated_words", "100 * n_repeat_words - 20 * n_words", high=0),
)
# Ratios: of word length, symbols, stop words and lines.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.5, high=14.0),
    Rule("long_words", "n_long_words", "n_words", high=0.2),
    Rule("symbols_to_words", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("letter_words", "n_letter_words", "n_words", low=0.5),
    Rule("capital_words", "n_capital_words", "n_words", high=0.5),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
)
LONG_WORD = 40


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def _count(words: Column, test) -> Column:
    return F.size(F.filter(words, test)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and the statistics of ``text``.

    A null text counts as empty: all statistics are zero. The windows of a text are told apart by
    a 64-bit hash of the hashes of their words.
    """
    own = [F.col(f"`{c}`") for c in docs.columns]
    text, words, lines = F.coalesce("text", F.lit("")), F.col("_words"), F.col("_lines")
    stop = sorted({w for listed in STOP_WORDS.values() for w in listed})
    zero = F.lit(0).cast("bigint")

    # Each step names what the next one uses more than once.
    step = docs.select(
        *own,
        _words(text).alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("_symbols"),
    )
    step = step.select(
        *own,
        "_words",
        F.size(words).cast("bigint").alias("n_words"),
        F.col("_symbols").cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.transform(words, lambda w: F.char_length(w)).alias("_sizes"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("_h"),
    )
    counts = [F.col(c) for c in ("n_words", "n_symbols", "n_lines", "n_dup_lines")]
    hashes = F.col("_h")
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]),
    )
    step = step.select(
        *own,
        *counts,
        F.aggregate("_sizes", zero, lambda total, n: total + n).alias("word_chars"),
        _count(F.col("_sizes"), lambda n: n > LONG_WORD).alias("n_long_words"),
        _count(words, lambda w: F.lower(F.btrim(w, F.lit(".,;:!?"))).isin(stop)).alias("n_stop_words"),
        _count(words, lambda w: w.rlike(r"\p{L}")).alias("n_letter_words"),
        _count(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w)).alias("n_capital_words"),
        F.when(F.size(hashes) >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_windows"),
    )
    counts += [F.col(c) for c in ("word_chars", "n_long_words", "n_stop_words", "n_letter_words", "n_capital_words")]
    # Windows sorted by hash, with their places; skipped where all differ.
    windows = F.col("_windows")
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    step = step.select(*own, *counts, F.when(repeats, placed).alias("_placed"))
    placed = F.col("_placed")

    def again(window: Column, i: Column) -> Column:
        beside = [F.coalesce(F.get(placed, j)["h"] == window["h"], F.lit(False)) for j in (i - 1, i + 1)]
        return beside[0] | beside[1]

    step = step.select(*own, *counts, F.sort_array(F.transform(F.filter(placed, again), lambda x: x["i"])).alias("_again"))
    # In order of place, a repeated window covers its words up to where the next one begins.
    places = F.col("_again")
    covered = F.transform(places, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - at, F.lit(WINDOW))))
    step = step.select(*own, *counts, covered.alias("_covered"))
    total = F.aggregate("_covered", zero, lambda total, n: total + n)
    return step.select(*own, *counts, F.coalesce(total, zero).alias("n_repeat_words"))


STATISTICS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_long_words", "n_stop_words", "n_letter_words", "n_capital_words",
)


def _judged(docs: DataFrame, rules: tuple[Rule, ...], base: tuple[Rule, ...]) -> DataFrame:
    """``document`` (the row as a struct), the statistics and the judgement."""
    stats = statistics(docs.select(as_row(docs).alias("document"), F.col("text").alias("text")))
    base_failed = F.lit(False)
    for rule in base:
        base_failed = base_failed | rule.fails()
    names = F.filter(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in (*base, *rules)]), lambda n: n.isNotNull())
    judged = stats.select("document", *STATISTICS, base_failed.alias("base_failed"), names.alias("failed"))
    # A filter on the result would be moved below these projections and repeat their expressions
    # for every use. It stays above a column that is not deterministic.
    return judged.withColumn("kept", (F.size("failed") == 0) & (F.monotonically_increasing_id() >= 0))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """The columns of ``docs``, the statistics, ``base_failed``, ``failed`` and ``kept``.

    ``failed`` names the rules a document fails, in the order of the table. A ratio to nothing (no
    words, no lines) fails no rule. Empty and null texts fail the base rule on words. Repeated rows
    are judged alike; an empty table gives no rows. A column of ``docs`` named like a result is
    left out.
    """
    new = (*STATISTICS, "base_failed", "failed", "kept")
    own = [F.col("document").getField(c).alias(c) for c in docs.columns if c not in new]
    return _judged(docs, rules, base).select(*own, *new)


def keep_passing(docs: DataFrame) -> DataFrame:
    """The documents that pass every rule, with the columns of ``docs``."""
    return from_row(_judged(docs, RULES, BASE).where("kept"), "document", docs.columns)
