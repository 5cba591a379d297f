"""SimHash near-duplicates: fingerprints, links by anchor-point covering, components.

Linking covers the space of half fingerprints with code words, the anchors. Two fingerprints that
differ in at most three bits differ in at most one bit in one of their 32-bit halves. A half is 31
bits under the perfect Hamming code, so that some anchor lies within one bit of every value, and
one bit that belongs to the anchor as it is. A half's nearest anchor is its home. If ``x`` and ``y``
differ in one bit, ``y`` lies within covering radius + threshold = 2 of the home of ``x``; so every
value is copied to all anchors within 2 (at most 17 of 2**27) and meets the others at their homes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import map_batches, one_of_each, signed, text_bytes, text_name
from nearkin.operators.graph import component_roots
from nearkin.session import discard, materialize

THRESHOLD = 3
SHINGLE = 3
SEED = 42
CODE_BITS = 31
# Parity checks of the Hamming code: bit b (counted from 1) takes part in check c if c's bit is set in b.
_CHECKS = [sum(1 << (b - 1) for b in range(1, CODE_BITS + 1) if b >> c & 1) for c in range(5)]


def _shingle_hashes(text: bytes, size: int) -> list[int]:
    words = text.lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    runs = zip(*(islice(words, i, None) for i in range(size)))
    return [xxhash.xxh64_intdigest(b" ".join(run), SEED) for run in runs]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash of a text: a bit is set if it is in over half the shingle hashes."""
    return majority(np.array(_shingle_hashes(text, size), dtype=np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, named: bool = False) -> DataFrame:
    """``doc_id, fp`` for every row; ``fp`` is the fingerprint as a signed 64-bit number.

    A text without words, empty or null, has fingerprint zero. ``named`` adds ``t``, the text's own hash.
    """
    names = ["doc_id", "fp", "t"][: 2 + named]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = [fingerprint(text, size) for text in text_bytes(batch.column(1))]
        fps = pa.array(signed(np.array(values, dtype=np.uint64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), fps, *batch.columns[2:]], names)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text", *[text_name()] * named)
    return map_batches(rows, run, ", ".join(f"{c} bigint" for c in names))


def _home_and_syndrome(half: Column) -> tuple[Column, Column]:
    code = half.bitwiseAND(F.lit((1 << CODE_BITS) - 1))
    syndrome = sum(((F.bit_count(code.bitwiseAND(F.lit(mask))) % 2) * (1 << c) for c, mask in enumerate(_CHECKS)), F.lit(0))
    return half, syndrome.cast("int")


def _flip(value: Column, bit: Column) -> Column:
    """Flip the code bit counted from 1; 0 flips nothing."""
    return value.bitwiseXOR(F.when(bit == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit - 1)))


def _halves(fps: DataFrame) -> DataFrame:
    mask = F.lit(0xFFFFFFFF)
    parts = F.array(
        F.struct(F.lit(0).alias("half"), F.shiftrightunsigned("fp", 32).alias("bits")),
        F.struct(F.lit(1).alias("half"), F.col("fp").bitwiseAND(mask).alias("bits")),
    )
    rows = fps.select("fp", F.explode(parts).alias("p")).select("fp", "p.half", "p.bits")
    return rows.select("fp", "half", "bits", _home_and_syndrome(F.col("bits"))[1].alias("s"))


def _key(half: Column, anchor: Column) -> Column:
    return F.call_function("shiftleft", half.cast("bigint"), F.lit(32)).bitwiseOR(anchor)


def links(fps: DataFrame) -> DataFrame:
    """``(i, j)``, ``i < j``: all pairs of distinct fingerprints that differ in at most three bits.

    ``fps`` has one row per distinct ``fp``. A pair is reported in the first half that brings it
    together. The distance is part of the join condition, so only links leave the join, and hot
    anchors are split by adaptive execution.
    """
    halves = _halves(fps)
    s, bits = F.col("s"), F.col("bits")
    homes = halves.select(_key(F.col("half"), _flip(bits, s)).alias("anchor"), F.col("fp").alias("i"))
    outer = F.lit(1 << CODE_BITS)
    near = F.array(_flip(bits, s), _flip(bits, s).bitwiseXOR(outer))
    # Two flips reach the code exactly if their positions add up (xor) to the syndrome.
    firsts = F.filter(F.sequence(F.lit(1), F.lit(CODE_BITS)), lambda a: (s != 0) & (a < a.bitwiseXOR(s)) & (a != s))
    pairs = F.transform(firsts, lambda a: _flip(_flip(bits, a), a.bitwiseXOR(s)))
    copies = halves.select("half", F.col("fp").alias("j"), F.explode(F.concat(near, pairs)).alias("a"))
    copies = copies.select(_key(F.col("half"), F.col("a")).alias("anchor"), "half", "j")
    difference = F.col("i").bitwiseXOR(F.col("j"))
    first_apart = F.bit_count(F.shiftrightunsigned(difference, 32)) > 1
    met = (F.col("i") < F.col("j")) & (F.bit_count(difference) <= THRESHOLD) & ((F.col("half") == 1) == first_apart)
    homes, copies = homes.alias("x").hint("merge"), copies.alias("y")
    return homes.join(copies, (F.col("x.anchor") == F.col("y.anchor")) & met).select("i", "j")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, named: bool = False) -> DataFrame:
    """``doc_id, fingerprint, component_id, fp, root`` for every row of ``docs``.

    Components are the connected sets of documents under links of at most three bits;
    ``component_id`` is the smallest ``doc_id`` in it, ``root`` is its own whatever its ids. Equal fingerprints are one vertex, so copies
    add no links. A row with a null ``doc_id`` takes part; it only names a component (by null) that
    has no other id. Repeated rows are returned as often as they come. An empty table gives no
    rows; columns other than ``doc_id`` and ``text`` are ignored. ``named`` adds ``t``, the text's hash.
    """
    rows = materialize(fingerprints(docs, size, named), "fingerprints")
    vertices = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    vertices = materialize(vertices, "fingerprint-vertices")
    edges = materialize(links(vertices.select("fp")), "fingerprint-links")
    roots = component_roots(edges)
    rooted = vertices.join(roots.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "fingerprint-roots")
    discard(edges)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(names, "root").select("fp", "component_id", "root")
    # Only classes of one fingerprint carry many rows; adaptive execution splits such a join.
    joined = rows.join(classes, "fp")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp", "root", *["t"] * named)


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The documents with one row of each near-duplicate component left, see ``one_of_each``."""
    return one_of_each(docs, near_duplicates(docs, size, named=True))
