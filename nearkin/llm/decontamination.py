"""Benchmark decontamination: pigeonhole edit matching with bit-parallel verification.

An item of ``n`` symbols may differ from a passage of a document by ``budget = floor(rate * n)`` edits.
Cut into ``budget + 1`` pieces, at least one piece occurs in the passage unchanged. All pieces are
found in one pass over a text (Aho-Corasick); around each hit, Myers' bit-parallel algorithm decides
whether the whole item occurs within the budget, so nothing within the budget is missed.

Texts are compared in lower case with white space runs as single spaces. The documents are only
scanned, never shuffled. The items go to the tasks in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import map_batches

RATE = 0.08
# Symbols of items matched in one scan of the documents; more items take more scans.
BLOCK_SYMBOLS = 8_000_000
SCHEMA = "doc_id bigint, item_id bigint, start bigint, end bigint, distance int, budget int"
_NOT_SPACE = re.compile(r"\S+")


def _lower(text: str) -> str:
    """Lower case, symbol for symbol."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def normalise(text: str) -> str:
    return " ".join(_lower(text).split())


def _places(text: str) -> list[int]:
    """For each symbol of the normalised text its place in ``text``."""
    places: list[int] = []
    for match in _NOT_SPACE.finditer(text):
        if places:
            places.append(places[-1] + 1)
        places.extend(range(match.start(), match.end()))
    return places


def _scores(pattern: str, text: str, anchored: bool) -> Iterator[int]:
    """Edit distance of ``pattern`` to the best stretch of ``text`` ending at each place.

    ``anchored``: the stretch has to begin where the text does.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, carry = mask, 0, m, int(anchored)
    for c in text:
        match = where.get(c, 0)
        low = match | minus
        diagonal = ((plus + (match & plus)) ^ plus) | low
        down = plus & diagonal
        up = minus | (~(plus | diagonal) & mask)
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | carry) & mask
        plus = (down << 1 | ~(diagonal | up)) & mask
        minus = up & diagonal
        yield score


def occurrences(item: str, text: str, budget: int) -> list[tuple[int, int, int]]:
    """``(start, end, distance)`` of the stretches of ``text`` within ``budget`` edits of ``item``.

    Of places that run together, the best end counts, the first of equals, with its best start.
    """
    found, run = [], []
    for at, score in enumerate(_scores(item, text, False)):
        if score <= budget:
            run.append((score, at + 1))
        elif run:
            found.append(min(run))
            run = []
    if run:
        found.append(min(run))
    spans = []
    for score, end in found:
        back = text[max(0, end - len(item) - score) : end][::-1]
        length = next((i + 1 for i, s in enumerate(_scores(item[::-1], back, True)) if s == score), 0)
        spans.append((end - length, end, score))
    return spans


class Matcher:
    """All items of a block against one text at a time."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = [(i, text, int(rate * len(text))) for i, text in items if text]
        self.pieces = ahocorasick.Automaton()
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * p // (budget + 1) for p in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                # The piece's end in the item, to tell where the item would begin.
                self.pieces.add_word(text[a:b], [*self.pieces.get(text[a:b], []), (n, b)])
        if self.items:
            self.pieces.make_automaton()

    def match(self, text: str) -> Iterator[tuple[int | None, int, int, int, int]]:
        begins: dict[int, set[int]] = {}
        if self.items:
            for at, hits in self.pieces.iter(text):
                for n, end in hits:
                    begins.setdefault(n, set()).add(at + 1 - end)
        for n, starts in begins.items():
            item_id, item, budget = self.items[n]
            stretches: list[list[int]] = []
            for start in sorted(starts):
                low, high = max(0, start - budget), start + len(item) + budget
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][1] = high
                else:
                    stretches.append([low, high])
            for low, high in stretches:
                for a, b, distance in occurrences(item, text[low:high], budget):
                    yield item_id, low + a, low + b, distance, budget


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, item_id, start, end, distance, budget``: passages of ``docs`` that match an item.

    ``start`` and ``end`` (exclusive) count the document's own code points. Only documents with a
    match have rows. Null and empty texts and items match nothing; a null ``item_id`` or ``doc_id`` is
    passed on as it is; repeated documents and items are all reported. Columns other than
    ``doc_id``/``item_id`` and ``text`` are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    return reduce(DataFrame.unionByName, [_scan(rows, items, rate) for items in _blocks(benchmark)])


def _blocks(benchmark: DataFrame) -> list[Broadcast]:
    """The items in broadcasts of about ``BLOCK_SYMBOLS`` symbols; at least one, maybe empty."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    parts = -(-(items.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_SYMBOLS) or 1
    shared = []
    for part in range(parts):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        texts = [(r["item_id"], normalise(r["text"])) for r in block.toLocalIterator()]
        shared.append(benchmark.sparkSession.sparkContext.broadcast(texts))
    return shared


def _scan(rows: DataFrame, items: Broadcast, rate: float) -> DataFrame:
    matchers: list[Matcher] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not matchers:
            matchers.append(Matcher(items.value, rate))
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hits = list(matchers[0].match(normalise(text))) if text else []
            places = _places(text) if hits else []
            for item_id, start, end, distance, budget in hits:
                span = (places[start], places[end - 1] + 1) if start < end else (0, 0)
                out.append((doc_id, item_id, *span, distance, budget))
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "start", "end", "distance", "budget"])

    return map_batches(rows, run, SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents without a match, with the columns of ``docs``.

    Rows are judged where they lie, each by its own text.
    """
    clean = docs
    for items in _blocks(benchmark):
        clean = clean.where(~_contaminated(items, rate)(F.col("text")))
    return clean


def _contaminated(items: Broadcast, rate: float) -> Callable[[Column], Column]:
    matchers: list[Matcher] = []

    @F.arrow_udf("boolean")
    def contaminated(texts: pa.Array) -> pa.Array:
        if not matchers:
            matchers.append(Matcher(items.value, rate))
        found = [next(matchers[0].match(normalise(t)), None) is not None if t else False for t in texts.to_pylist()]
        return pa.array(found, pa.bool_())

    return contaminated
