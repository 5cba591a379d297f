"""Per-position statistics of a sample: profile, entropy, consensus, entropy-balanced chunks.

Long form throughout: one row per (sample, position, symbol). Counting is a plain grouped
aggregate whose key space is positions x alphabet, so the partial step on each partition
collapses the exploded symbols before anything is shuffled.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.encode import DEFAULT_ALPHABET, digit_to_letter, lmer_set
from nearkin.session import materialize, spread

# Smallest frequency that counts in entropy, smallest major-allele frequency,
# widest entropy chunk, symbol of a position nobody covers, symbol left out of a consensus.
ENTROPY_EPS = 0.000_001
MAJOR_MIN = 0.001
MAX_CHUNK_WIDTH = 32
UNCOVERED = "$"
NOT_CALLED = "N"


def max_length(df: DataFrame, seq: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.length(seq)).alias("max_length"))


def symbol_counts(df: DataFrame, seq: str, by: list[str] = [], alphabet: str = DEFAULT_ALPHABET) -> DataFrame:
    """``(by..., pos, sym, digit, cnt)`` of the alphabet's symbols; positions are 0-based."""
    symbols = df.select(*by, F.posexplode(F.split(seq, "")).alias("pos", "sym"))
    digit = F.instr(F.lit(alphabet), F.col("sym")) - 1
    kept = symbols.where((F.length("sym") == 1) & (digit >= 0))
    counted = kept.groupBy(*by, "pos", "sym").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.withColumn("digit", digit)


def profile(df: DataFrame, seq: str, by: list[str] = [], alphabet: str = DEFAULT_ALPHABET) -> DataFrame:
    """Frequency of each alphabet symbol at each position, zeros included.

    The denominator is the number of strings, so a position not covered by all of them (or
    holding other symbols) sums to less than 1.
    """
    totals = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.max(F.length(seq)).alias("width")
    )
    # A constant key lets ungrouped totals (one row) meet the counts in an ordinary equi-join.
    keys = by or ["_all"]
    if not by:
        totals = totals.withColumn("_all", F.lit(0))
    digits = F.explode(F.sequence(F.lit(0), F.lit(len(alphabet) - 1))).alias("digit")
    cells = (
        totals.where("width > 0")
        .select(*keys, "total", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos"))
        .select(*keys, "total", "pos", digits)
    )
    counts = symbol_counts(df, seq, by, alphabet).drop("sym")
    joined = cells.join(counts, by + ["pos", "digit"], "left")
    return joined.select(
        *by,
        "pos",
        "digit",
        F.substring(F.lit(alphabet), F.col("digit") + 1, F.lit(1)).alias("sym"),
        (F.coalesce("cnt", F.lit(0)) / F.col("total")).alias("freq"),
    )


def entropy(prof: DataFrame, by: list[str] = []) -> DataFrame:
    """Shannon entropy (natural log) per position."""
    p = F.col("freq")
    term = F.when(p < ENTROPY_EPS, 0.0).otherwise(-p * F.ln(p))
    return prof.groupBy(*by, "pos").agg(F.sum(term).alias("entropy"))


def total_entropy(ent: DataFrame, by: list[str] = []) -> DataFrame:
    return ent.groupBy(*by).agg(F.sum("entropy").alias("total_entropy"))


def _argmax(value: Column | str) -> Column:
    """Digit with the greatest value, the lowest digit on ties."""
    value = F.col(value) if isinstance(value, str) else value
    return F.max_by("digit", F.struct(value, -F.col("digit")))


def major_allele(prof: DataFrame, by: list[str] = []) -> DataFrame:
    """Digit of the most frequent symbol per position, -1 where none reaches the minimum."""
    best = prof.groupBy(*by, "pos").agg(_argmax("freq").alias("digit"), F.max("freq").alias("freq"))
    return best.select(*by, "pos", F.when(F.col("freq") < MAJOR_MIN, -1).otherwise(F.col("digit")).alias("major"))


def _spell(letters: DataFrame, by: list[str], letter: Column) -> DataFrame:
    """Concatenate one letter per position; a row is as long as one string of the sample."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["letter"]), "")
    return letters.groupBy(*by).agg(joined.alias("consensus"))


def consensus(df: DataFrame, seq: str, by: list[str] = [], alphabet: str = DEFAULT_ALPHABET) -> DataFrame:
    """Most frequent symbol per position over the strings themselves.

    Ties go to the symbol that comes first in the alphabet. Symbols outside the alphabet are not
    counted.
    """
    return _called(symbol_counts(df, seq, by, alphabet), by, alphabet)


def index_and_consensus(df: DataFrame, seq: str, l: int, by: list[str] = [], alphabet: str = DEFAULT_ALPHABET) -> tuple[DataFrame, DataFrame]:
    """``(by..., lmer, freq)`` and ``(by..., consensus)`` from one scan and one grouped count.

    A string's distinct l-mers and its symbols by position are taken apart together; l-mers have no
    position. Both results read the written counts.
    """
    lmers = F.transform(lmer_set(seq, l), lambda s: F.struct(F.lit(-1).alias("pos"), s.alias("sym")))
    symbols = F.transform(F.split(seq, ""), lambda s, i: F.struct(i.alias("pos"), s.alias("sym")))
    # A task's own counts are held in memory, so a task gets some megabytes of strings.
    cells = spread(df.select(*by, seq), seq).select(*by, F.explode(F.concat(lmers, symbols)).alias("cell")).select(*by, "cell.pos", "cell.sym")
    counts = materialize(cells.groupBy(*by, "pos", "sym").agg(F.count(F.lit(1)).alias("cnt")), "counts")
    digit = F.instr(F.lit(alphabet), F.col("sym")) - 1
    called = counts.withColumn("digit", digit).where("pos >= 0 and length(sym) = 1 and digit >= 0")
    index = counts.where("pos < 0").select(*by, F.col("sym").alias("lmer"), F.col("cnt").alias("freq"))
    return index, _called(called, by, alphabet)


def _called(counts: DataFrame, by: list[str], alphabet: str) -> DataFrame:
    voters = alphabet[:-1] if NOT_CALLED in alphabet else alphabet
    votes = F.when(F.col("digit") < len(voters), F.col("cnt")).otherwise(0)
    best = counts.groupBy(*by, "pos").agg(_argmax(votes).alias("digit"), F.max(votes).alias("votes"))
    winner = F.when(F.col("votes") > 0, F.col("digit")).otherwise(0)
    return _spell(best, by, digit_to_letter(winner))


def profile_consensus(prof: DataFrame, by: list[str] = [], alphabet: str = DEFAULT_ALPHABET) -> DataFrame:
    """Major allele per position spelled in the alphabet, ``$`` where there is none."""
    letter = F.substring(F.lit(alphabet), F.col("major") + 1, F.lit(1))
    return _spell(major_allele(prof, by), by, F.when(F.col("major") < 0, UNCOVERED).otherwise(letter))


def _balanced_ends(entropies: list[float], chunks: int) -> list[int]:
    """Ends of ``chunks`` consecutive runs whose entropy sums are near-equal.

    A run takes the next position while that brings its sum closer to the target or costs
    nothing, up to the maximal width; a run cut short by the width passes its deficit on to the
    rest. The last run takes what remains.
    """
    width = len(entropies)
    target = sum(entropies) / chunks
    ends: list[int] = []
    start = 0
    for remaining in range(chunks - 1, 0, -1):
        stop, filled = start, 0.0
        while stop < width and stop - start < MAX_CHUNK_WIDTH:
            gain = entropies[stop]
            gap = filled - target
            if gain >= ENTROPY_EPS and abs(gap + gain) >= abs(gap):
                break
            filled += gain
            stop += 1
        if stop - start == MAX_CHUNK_WIDTH:
            target += (target - filled) / remaining
        ends.append(stop - 1)
        start = stop
    return ends + [width - 1]


def entropy_chunks(ent: DataFrame, chunks: int, by: list[str] = []) -> DataFrame:
    """``(by..., chunk, end)`` of the entropy-balanced cut.

    Each group holds one number per position, so it is as small as one string of the sample,
    however many strings the sample has.
    """
    if chunks < 1:
        raise ValueError("at least one chunk is needed")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = _balanced_ends(pdf.sort_values("pos")["entropy"].tolist(), chunks)
        out = pd.DataFrame({"chunk": range(chunks), "end": ends})
        for name in reversed(by):
            out.insert(0, name, pdf[name].iloc[0])
        return out

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ent.schema if f.name in by] + ["chunk int, end int"])
    return ent.groupBy(*by).applyInPandas(cut, schema)
