"""Hamming, Levenshtein and q-gram measures between two string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearkin.functions.encode import PACKINGS, _col, packed_words


def _check_threshold(k: int) -> None:
    if k < 0:
        raise ValueError("threshold must not be negative")


def _differing_words(left: Column | str, right: Column | str) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.zip_with(_col(left), _col(right), lambda x, y: F.coalesce(x, zero).bitwiseXOR(F.coalesce(y, zero)))


def _differing_symbols(words: Column, packing: str) -> Column:
    per_word, bits = PACKINGS[packing]
    ones = sum(1 << (bits * i) for i in range(per_word))

    def count(total: Column, diff: Column) -> Column:
        # Fold each symbol's bits onto its lowest one.
        if packing == "dna":
            folded = diff.bitwiseOR(F.shiftrightunsigned(diff, 1)).bitwiseOR(F.shiftrightunsigned(diff, 2))
        else:
            folded, shift = diff, bits // 2
            while shift:
                folded = folded.bitwiseOR(F.shiftrightunsigned(folded, shift))
                shift //= 2
        return total + F.bit_count(folded.bitwiseAND(F.lit(ones)))

    return F.aggregate(words, F.lit(0), count)


def packed_hamming(left: Column | str, right: Column | str, packing: str) -> Column:
    """Differing symbols of two packed strings; the longer one's tail counts in full."""
    return _differing_symbols(_differing_words(left, right), packing)


def packed_hamming_bounded(left: Column | str, right: Column | str, k: int, packing: str) -> Column:
    """The same, or -1 above ``k``.

    Equal words are skipped, and more than ``k`` differing words decide before any symbol is counted.
    """
    _check_threshold(k)
    words = F.filter(_differing_words(left, right), lambda w: w != 0)

    def judged(words: Column) -> Column:
        d = _differing_symbols(words, packing)
        return F.when(F.size(words) > k, -1).otherwise(F.when(d <= k, d).when(d > k, -1))

    # Bound to a variable, so that words are compared once.
    return F.element_at(F.transform(F.array(words), judged), 1)


def padded_hamming(left: Column | str, right: Column | str, packing: str = "unicode") -> Column:
    """Hamming distance after padding the shorter string with a symbol neither contains."""
    return packed_hamming(packed_words(left, packing), packed_words(right, packing), packing)


def hamming(left: Column | str, right: Column | str, packing: str = "unicode") -> Column:
    """Positions at which two strings of one length differ; anything else raises."""
    left, right = _col(left), _col(right)
    return _same_length(left, right, padded_hamming(left, right, packing))


def _same_length(left: Column, right: Column, value: Column) -> Column:
    legal = left.isNotNull() & right.isNotNull() & (F.length(left) == F.length(right))
    message = F.lit("Hamming distance needs two strings of the same length")
    return F.when(legal, value).otherwise(F.raise_error(message).cast("int"))


def hamming_bounded(left: Column | str, right: Column | str, k: int, packing: str = "unicode") -> Column:
    """Hamming distance, or -1 above ``k``."""
    left, right = _col(left), _col(right)
    d = packed_hamming_bounded(packed_words(left, packing), packed_words(right, packing), k, packing)
    return _same_length(left, right, d)


def _not_null(left: Column, right: Column, value: Column) -> Column:
    message = F.lit("strings must not be null")
    return F.when(left.isNotNull() & right.isNotNull(), value).otherwise(F.raise_error(message).cast("int"))


def levenshtein(left: Column | str, right: Column | str) -> Column:
    left, right = _col(left), _col(right)
    return _not_null(left, right, F.levenshtein(left, right))


def levenshtein_bounded(left: Column | str, right: Column | str, k: int) -> Column:
    """Levenshtein distance, or -1 above ``k``."""
    _check_threshold(k)
    left, right = _col(left), _col(right)
    return _not_null(left, right, F.levenshtein(left, right, k))


# Symbols compared at once while a run of equal ones lasts: the first block, the longest, and how much
# longer each next one is.
RUN, LONGEST_RUN, GROWTH = 4, 4096, 8
# Pairs judged together: their diagonals are in memory at once.
TOGETHER = 4096


def _symbols(texts: list[str], after: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings, one after the other with ``after`` in between, and where each begins."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(starts[-1] + LONGEST_RUN, after, dtype=np.uint32)
    inside = np.ones(starts[-1], dtype=bool)
    inside[starts[1:] - 1] = False
    flat[: starts[-1]][inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return flat, starts[:-1]


def _run_ends(x: np.ndarray, at_x: np.ndarray, y: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """How many symbols are equal from each of the given places on.

    Places whose run goes on are compared again in longer blocks, so a run costs about as many
    comparisons as it has symbols and a few rounds. Strings end in symbols that equal nothing.
    """
    found = np.zeros(len(at_x), dtype=np.int64)
    going, block = np.arange(len(at_x)), RUN
    while len(going):
        more = np.arange(block)
        # Bounded memory: long blocks are taken for some places at a time.
        several = max(1, (1 << 22) // block)
        whole = []
        for part in (going[i : i + several] for i in range(0, len(going), several)):
            from_x, from_y = at_x[part] + found[part], at_y[part] + found[part]
            differs = x[from_x[:, None] + more] != y[from_y[:, None] + more]
            stops = differs.any(axis=1)
            found[part] += np.where(stops, differs.argmax(axis=1), block)
            whole.append(part[~stops])
        going, block = np.concatenate(whole), min(block * GROWTH, LONGEST_RUN)
    return found


def edits_within(xs: list[str], ys: list[str], k: int) -> np.ndarray:
    """Levenshtein distance of each pair, or -1 above ``k``.

    All pairs advance together, edit by edit: for each diagonal, the furthest place that so many
    edits reach, from the three diagonals around it one edit earlier, followed by the run of equal
    symbols there. Work is bounded by ``k * (2 k + 1)`` places a pair and the runs between them,
    whatever the length.
    """
    result = np.full(len(xs), -1, dtype=np.int32)
    len_x, len_y = (np.array([len(t) for t in texts], dtype=np.int64) for texts in (xs, ys))
    pairs = np.flatnonzero(np.abs(len_x - len_y) <= k)
    if not len(pairs):
        return result
    (x, start_x), (y, start_y) = _symbols([xs[i] for i in pairs], 0xFFFFFFFF), _symbols([ys[i] for i in pairs], 0xFFFFFFFE)
    len_x, len_y = len_x[pairs], len_y[pairs]
    goal = len_y - len_x + k
    diagonals, nowhere = np.arange(-k, k + 1), -(1 << 40)
    ends = np.full((len(pairs), 2 * k + 3), nowhere, dtype=np.int64)
    # One column on each side stands for the diagonals beyond reach.
    ends[:, k + 1] = _run_ends(x, start_x, y, start_y)
    for edits in range(k + 1):
        done = ends[np.arange(len(pairs)), goal + 1] >= len_x
        result[pairs[done]] = edits
        if done.any():
            left = ~done
            pairs, start_x, start_y, len_x, len_y, goal, ends = (a[left] for a in (pairs, start_x, start_y, len_x, len_y, goal, ends))
        if edits == k or not len(pairs):
            break
        far = np.maximum(np.maximum(ends[:, :-2], ends[:, 1:-1] + 1), ends[:, 2:] + 1)
        far = np.minimum(far, np.minimum(len_x[:, None], len_y[:, None] - diagonals))
        # Diagonals too far from the last one for the edits that are left go no further.
        useful = (far >= 0) & (far + diagonals >= 0) & (np.abs(goal[:, None] - k - diagonals) <= k - edits - 1)
        row, column = np.nonzero(useful)
        place = far[row, column]
        ends[:] = nowhere
        ends[row, column + 1] = place + _run_ends(x, start_x[row] + place, y, start_y[row] + place + diagonals[column])
    return result


def bounded_levenshtein(left: Column | str, right: Column | str, k: int) -> Column:
    """Levenshtein distance, or -1 above ``k``, of strings of any length; null if one of them is null."""

    @F.arrow_udf("int")
    def distance(xs: pa.Array, ys: pa.Array) -> pa.Array:
        given = pa.compute.and_(xs.is_valid(), ys.is_valid())
        found = np.zeros(len(xs), dtype=np.int32)
        rows = np.flatnonzero(given.to_numpy(zero_copy_only=False))
        for at in range(0, len(rows), TOGETHER):
            part = pa.array(rows[at : at + TOGETHER])
            found[rows[at : at + TOGETHER]] = edits_within(xs.take(part).to_pylist(), ys.take(part).to_pylist(), k)
        return pa.array(found, pa.int32(), mask=~given.to_numpy(zero_copy_only=False))

    return distance(_col(left), _col(right))
