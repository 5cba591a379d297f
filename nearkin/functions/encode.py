"""Encodings of one string: padding, digits, l-mers, chunks and packed words.

Every function maps Columns to a Column and, sketches aside, stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Default alphabet, padding symbol, and the letters a digit decodes to.
DEFAULT_ALPHABET = "ACGT"
PAD = "%"
DIGIT_LETTERS = "ACGT-"
UNKNOWN_LETTER = "_"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pad_right(seq: Column | str, width: Column | int) -> Column:
    """Pad to ``width`` with the padding symbol; longer strings are left alone."""
    seq = _col(seq)
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(seq, F.repeat(F.lit(PAD), F.greatest(width - F.length(seq), F.lit(0))))


def letter_to_digit(letter: Column | str, alphabet: str = DEFAULT_ALPHABET) -> Column:
    """0-based position of a letter in the alphabet, -1 when it is not a member."""
    return F.instr(F.lit(alphabet), _col(letter)) - 1


def digit_to_letter(digit: Column | str) -> Column:
    digit = _col(digit)
    known = digit.between(0, len(DIGIT_LETTERS) - 1)
    return F.when(known, F.substring(F.lit(DIGIT_LETTERS), digit + 1, F.lit(1))).otherwise(UNKNOWN_LETTER)


# Symbols per block when a string is taken apart. Reaching a position in a UTF-8 string means
# walking to it, so cutting long strings in two steps saves most of that walk.
BLOCK = 256


def _in_blocks(seq: Column, size: int, overlap: int, parts: Callable[[Column], Column]) -> Column:
    """Parts of consecutive blocks of ``size`` symbols (plus ``overlap`` more), in one array.

    Lambda arguments hold values, so ``seq`` is evaluated once even if it is an expression.
    """

    def blocks(s: Column) -> Column:
        last = F.greatest(F.ceil(F.length(s) / size).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.substring(s, b * size + 1, F.lit(size + overlap)))

    return F.flatten(F.transform(F.flatten(F.transform(F.array(seq), blocks)), parts))


def lmers(seq: Column | str, l: int) -> Column:
    """All substrings of length ``l`` in order of position; empty for shorter strings."""

    def every(block: Column) -> Column:
        n = F.length(block) - l + 1
        cut = F.transform(F.sequence(F.lit(1), n), lambda p: F.substring(block, p, F.lit(l)))
        return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))

    return _in_blocks(_col(seq), BLOCK, l - 1, every)


def lmer_set(seq: Column | str, l: int) -> Column:
    return F.array_distinct(lmers(seq, l))


def lmer_code(lmer: Column | str, alphabet: str = DEFAULT_ALPHABET) -> Column:
    """Polynomial value of a substring in the base of the alphabet, modulo 2^64.

    Letters outside the alphabet count as -1. Computed as a digit fold, with the wrap-around
    done in two 32-bit halves because ANSI arithmetic refuses to overflow.
    """
    lmer = _col(lmer)
    base, mask = len(alphabet), (1 << 32) - 1

    def step(acc: Column, p: Column) -> Column:
        low = acc["lo"] * base + letter_to_digit(F.substring(lmer, p, F.lit(1)), alphabet).cast("bigint")
        high = acc["hi"] * base + F.shiftright(low, 32)
        return F.struct(high.bitwiseAND(F.lit(mask)).alias("hi"), low.bitwiseAND(F.lit(mask)).alias("lo"))

    zero = F.struct(F.lit(0).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("lo"))
    join = lambda acc: F.shiftleft(acc["hi"], 32).bitwiseOR(acc["lo"])
    folded = F.aggregate(F.sequence(F.lit(1), F.length(lmer)), zero, step, join)
    return F.when(F.length(lmer) > 0, folded).otherwise(F.lit(0).cast("bigint"))


def lmer_codes(seq: Column | str, l: int, alphabet: str = DEFAULT_ALPHABET) -> Column:
    """Code of every l-mer, in order of position.

    Codes below 2^62 are made by doubling: those of twice the length join two neighbouring ones, so the
    work grows with the logarithm of ``l``. Longer ones are folded one by one, modulo 2^64.
    """
    base = len(alphabet)
    if l < 1 or base**l >= 1 << 62:
        return F.transform(lmers(seq, l), lambda s: lmer_code(s, alphabet))

    def joined(first: Column, second: Column, offset: int, factor: int) -> Column:
        """Codes of ``first``, each continued by the one of ``second`` that starts ``offset`` later."""

        def both(a: Column) -> Column:
            b = a if second is first else second
            kept = F.slice(a, 1, F.greatest(F.size(b) - offset, F.lit(0)))
            return F.transform(kept, lambda x, i: x * factor + F.get(b, i + offset))

        return F.transform(F.array(first), both)[0]

    def codes(digits: Column) -> Column:
        found, size = digits, 1
        for bit in bin(l)[3:]:
            found, size = joined(found, found, size, base**size), 2 * size
            if bit == "1":
                found, size = joined(found, digits, size, base), size + 1
        return found

    digits = F.transform(lmers(seq, 1), lambda s: letter_to_digit(s, alphabet).cast("bigint"))
    return F.transform(F.array(digits), codes)[0]


def equal_chunks(seq: Column | str, l: int) -> Column:
    """The string cut at 0, l, 2l, ...; a tail shorter than ``l`` belongs to no chunk."""
    seq = _col(seq)
    n = F.floor(F.length(seq) / l).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.substring(seq, c * l + 1, F.lit(l)))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def chunks_at(seq: Column | str, ends: Column) -> Column:
    """The string cut at given ends: chunk 0 is ``[0, ends[0])``, chunk r ``[ends[r-1], ends[r])``."""
    seq = _col(seq)

    def cut(end: Column, r: Column) -> Column:
        start = F.when(r == 0, F.lit(0)).otherwise(F.get(ends, r - 1))
        return F.substring(seq, start + 1, end - start)

    return F.transform(ends, cut)


# Packed words: symbols laid side by side in BIGINTs so that XOR compares many at once. Zero
# means "no symbol", which makes a missing tail differ from every letter, as padding should.
# name -> (symbols per word, bits per symbol)
PACKINGS = {"dna": (21, 3), "ascii": (8, 8), "unicode": (2, 32)}
DNA_SYMBOLS, DNA_DIGITS = "ACGTN-", "123456"


def packed_words(seq: Column | str, packing: str) -> Column:
    """The string as an ``array<bigint>`` of packed symbols."""
    per_word, _ = PACKINGS[packing]

    def words(block: Column) -> Column:
        last = F.greatest(F.ceil(F.length(block) / per_word).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda w: word(F.substring(block, w * per_word + 1, F.lit(per_word))))

    def word(part: Column) -> Column:
        if packing == "dna":
            digits, radix, width = F.translate(part, DNA_SYMBOLS, DNA_DIGITS), 8, per_word
        elif packing == "ascii":
            digits, radix, width = F.hex(part), 16, 2 * per_word
        else:
            # One more than the code point: zero is a symbol of its own, "no symbol" another.
            codes = [F.when(F.length(part) > i, F.ascii(F.substring(part, i + 1, 1)) + 1).otherwise(0).cast("bigint") for i in range(per_word)]
            return reduce(lambda high, low: F.shiftleft(high, 32).bitwiseOR(low), codes)
        return F.conv(F.rpad(digits, width, "0"), radix, 10).cast("bigint")

    return _in_blocks(_col(seq), BLOCK // per_word * per_word, 0, words)


def packing_of(seq: Column | str) -> Column:
    """0, 1 or 2: the first of :data:`PACKINGS` able to hold the string."""
    seq = _col(seq)
    return (
        F.when(F.rlike(seq, F.lit(r"\A[ACGTN-]*+\z")), 0)
        .when((F.octet_length(seq) == F.length(seq)) & ~F.contains(seq, F.lit("\0")), 1)
        .otherwise(2)
    )


# Symbols taken apart together.
SLICE_SYMBOLS = 1 << 20


def slices(texts: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows with about ``SLICE_SYMBOLS`` symbols each; a longer row is one of its own."""
    part = np.cumsum(pc.coalesce(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // SLICE_SYMBOLS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [(i, j) for i, j in zip(cuts, cuts[1:]) if j > i]


def counted_lmers(texts: list[str], groups: np.ndarray, l: int) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Each group's distinct l-mers with their numbers; ``groups`` has a small number for every text.

    An l-mer is the number that its symbols are the digits of, in the base of the symbols in use. Where numbers
    would grow too large, they are replaced by their ranks.
    """
    whole = "".join(texts)
    symbols = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    starts = np.flatnonzero(row[: len(row) - l + 1] == row[l - 1 :]) if len(row) >= l else np.empty(0, dtype=np.int64)
    if not len(starts):
        return np.empty(0, dtype=np.int64), [], np.empty(0, dtype=np.int64)
    present = np.zeros(int(symbols.max()) + 1, dtype=np.int64)
    present[symbols] = 1
    base, digits = int(present.sum()), (np.cumsum(present) - 1)[symbols]
    codes, bound = groups[row[starts]].astype(np.int64), int(groups.max()) + 1
    for place in range(l):
        if bound * base >= 1 << 62:
            known, codes = np.unique(codes, return_inverse=True)
            bound = len(known)
        codes, bound = codes * base + digits[starts + place], bound * base
    _, first, counts = np.unique(codes, return_index=True, return_counts=True)
    at = starts[first]
    return groups[row[at]], [whole[i : i + l] for i in at.tolist()], counts


# Parities of a string's pairs of neighbouring symbols, in so many words of 64 bits.
SKETCH = ("s0", "s1", "s2", "s3")
_PAIR_MIX, _BIT_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def sketches(texts: list[str]) -> np.ndarray:
    """One row of words for each text: bit ``b`` tells whether an odd number of its symbol pairs hash to ``b``.

    An edit takes away or adds at most four pairs of neighbours, so it turns at most four bits.
    """
    bits = 64 * len(SKETCH)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    mixed = (symbols[:-1] * _PAIR_MIX + symbols[1:]) * _BIT_MIX
    mixed ^= mixed >> np.uint64(29)
    mixed *= _PAIR_MIX
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    inside = row[:-1] == row[1:]
    place = row[:-1][inside] * bits + (mixed[inside] >> np.uint64(56)).astype(np.int64) % bits
    odd = np.bincount(place, minlength=len(texts) * bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8").reshape(len(texts), len(SKETCH))


def sketch(seq: Column | str) -> Column:
    """The sketch of a string as an ``array<bigint>``."""

    @F.arrow_udf("array<bigint>")
    def words(texts: pa.Array) -> pa.Array:
        found = [sketches([t or "" for t in texts[i:j].to_pylist()]) for i, j in slices(texts)]
        flat = np.concatenate([f.ravel() for f in found]) if found else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(SKETCH)), pa.array(flat))

    return words(_col(seq))


# Base of the polynomials that pieces are hashed by, and its inverse modulo 2**64.
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[:1] = 1
    return np.cumprod(found, dtype=np.uint64)


def _piece(length: np.ndarray, m: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of piece ``m`` when ``length`` is split into ``k + 1`` near-equal pieces."""
    size, short = length // (k + 1), k + 1 - length % (k + 1)
    return m * size + np.maximum(m - short, 0), size + (m >= short)


def pieces(texts: list[str], k: int, limit: int | None = None, shifts: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``texts``, keys of pieces, and ``length * (k + 1) + m`` of these: each text's own ``k + 1`` in their order, or, with ``limit``, those it looks for.

    A text looks for piece ``m`` of texts as long as itself to ``k`` longer, above ``limit``, where ``m`` earlier edits
    can have moved it from the left and ``k - m`` later ones from the right; ``shifts=False`` looks at the
    piece's own place only. Any part of a text is hashed by the difference of two sums.
    """
    length = np.array([len(t) for t in texts], dtype=np.int64)
    start = np.cumsum(length) - length
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    symbols = (symbols + np.uint64(1)) * _PAIR_MIX
    symbols ^= symbols >> np.uint64(32)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(symbols * _powers(_BASE, len(symbols)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(symbols) + 1)
    rows, keys, named = [], [], []

    def add(some: np.ndarray, target: np.ndarray, m: int, at: np.ndarray, size: np.ndarray) -> None:
        first = start[some] + at
        key = (sums[first + size] - sums[first]) * back[first] * _BIT_MIX
        key ^= key >> np.uint64(31)
        key += (target * (k + 1) + m).astype(np.uint64)
        key *= _PAIR_MIX
        rows.append(some)
        keys.append(key ^ key >> np.uint64(29))
        named.append(target * (k + 1) + m)

    for m in range(k + 1):
        if limit is None:
            add(np.arange(len(texts)), length, m, *_piece(length, m, k))
            continue
        for more in range(k + 1):
            some = np.flatnonzero(length + more > limit)
            target = length[some] + more
            place, size = _piece(target, m, k)
            for shift in range(max(-m, -more - (k - m)), min(m, k - m - more) + 1) if shifts else (0,):
                inside = (place + shift >= 0) & (place + shift + size <= length[some])
                add(some[inside], target[inside], m, place[inside] + shift, size[inside])
    row, key, piece = np.concatenate(rows), np.concatenate(keys), np.concatenate(named)
    if limit is None:
        order = np.argsort(row, kind="stable")
        return row[order], key[order], piece[order]
    order = np.lexsort((key, piece, row))
    row, key, piece = row[order], key[order], piece[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])
    return row[new], key[new], piece[new]


def _piece_lists(seq: Column | str, k: int, *looked_for) -> Column:
    @F.arrow_udf("array<bigint>")
    def lists(texts: pa.Array) -> pa.Array:
        counts, keys = [np.zeros(1, dtype=np.int64)], []
        for i, j in slices(texts):
            row, key, _ = pieces([t or "" for t in texts[i:j].to_pylist()], k, *looked_for)
            counts.append(np.bincount(row, minlength=j - i))
            keys.append(key)
        flat = np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(counts)).astype(np.int32)), pa.array(flat))

    return lists(_col(seq))


def piece_keys(seq: Column | str, k: int) -> Column:
    """Keys of a string's ``k + 1`` near-equal pieces, see ``pieces``."""
    return _piece_lists(seq, k)


def piece_probes(seq: Column | str, k: int, limit: int, shifts: bool) -> Column:
    """Keys of the pieces that a string looks for, see ``pieces``."""
    return _piece_lists(seq, k, limit, shifts)


def piece_probes_in_order(seq: Column | str, k: int, limit: int) -> Column:
    """``key, earlier`` of the pieces that a string looks for: ``earlier`` has the keys of earlier pieces of strings as long."""

    @F.arrow_udf("array<struct<key:bigint,earlier:array<bigint>>>")
    def lists(texts: pa.Array) -> pa.Array:
        counts, keys, sizes, before = [np.zeros(1, dtype=np.int64)], [], [np.zeros(1, dtype=np.int64)], []
        for i, j in slices(texts):
            row, key, piece = pieces([t or "" for t in texts[i:j].to_pylist()], k, limit)
            # Keys come by row, length and piece: those of one length are neighbours, and so are those of a piece.
            place = np.arange(len(row))
            new_length, new_piece = np.ones(len(row), dtype=bool), np.ones(len(row), dtype=bool)
            new_length[1:] = (row[1:] != row[:-1]) | (piece[1:] // (k + 1) != piece[:-1] // (k + 1))
            new_piece[1:] = new_length[1:] | (piece[1:] != piece[:-1])
            first = np.maximum.accumulate(np.where(new_length, place, 0))
            size = np.maximum.accumulate(np.where(new_piece, place, 0)) - first
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            counts.append(np.bincount(row, minlength=j - i))
            keys.append(key)
            sizes.append(size)
            before.append(key[at])
        flat, earlier = (np.concatenate(x).view(np.int64) if x else np.empty(0, dtype=np.int64) for x in (keys, before))
        ends = lambda x: pa.array(np.cumsum(np.concatenate(x)).astype(np.int32))
        rows = pa.StructArray.from_arrays([pa.array(flat), pa.ListArray.from_arrays(ends(sizes), pa.array(earlier))], ["key", "earlier"])
        return pa.ListArray.from_arrays(ends(counts), rows)

    return lists(_col(seq))
