"""Helpers shared by the document operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that separates words: space and the control characters 9 to 13. It is what
# bytes.split() without an argument splits on.
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

# Bytes of text handled at once inside a task; longer texts are handled alone.
BLOCK_BYTES = 4 << 20


def as_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that no name of ``docs`` meets one of an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def from_row(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """The columns put away by ``as_row``."""
    return df.select(*[F.col(row).getField(c).alias(c) for c in columns])


def text_name() -> Column:
    """A hash that stands for a row's text."""
    return F.xxhash64("text").alias("t")


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: the one of smallest id.

    ``members`` has ``doc_id``, ``t`` (the text's hash) and ``root`` (the component) for every row. Null ids
    come last, rows of equal ids are told apart by their texts; of rows equal in both one stays. Every
    component keeps exactly one row, whatever its ids. Columns are those of ``docs``.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")
    first = members.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.doc_id").alias("kept_id"), F.col("first.t").alias("kept_t"))
    rows = docs.select(as_row(docs).alias("document"), F.col("doc_id").cast("bigint").alias("id"), text_name())
    rows = rows.join(first, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("t") == F.col("kept_t")))
    return from_row(rows.dropDuplicates(["root"]), "document", docs.columns)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash_share(key: Column, parts: int) -> Column:
    """crc32 of a key's text form modulo ``parts``; a null key counts as the empty text."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(sizes: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``limit``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a generator over Arrow batches to every partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


# White space as tokenizers' patterns have it, in runs too long for their regular expressions.
_LONG_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")


def encode_whole(encoding, text: str) -> np.ndarray:
    """Ids of a whole text without special tokens, whatever its length.

    The pattern is to end in ``\\s+(?!\\S)|\\s+``: a run of white space is a piece but for its last symbol,
    which may belong to what follows. Runs that would exhaust the expression are taken as that piece.
    """
    parts, at = [], 0
    for run in _LONG_WHITE.finditer(text) if len(text) >= 100_000 else ():
        end = run.end() - (run.end() < len(text))
        parts += [encoding.encode_ordinary(text[at : run.start()]), encoding._encode_single_piece(text[run.start() : end])]
        at = end
    rest = encoding.encode_to_numpy(text[at:], disallowed_special=())
    return np.concatenate([*map(np.array, parts), rest]).astype(np.uint32) if parts else rest


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as Spark's bigint."""
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)
