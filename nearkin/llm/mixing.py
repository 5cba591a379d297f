"""Mixing sources to target weights by fitting each source's word budget as a subset sum.

A source's target is a number of words. Whole passes over the source come first; what is left of the
budget is filled with documents. They are counted by exact length, every length gives its share
rounded down or up, in proportion to its remainder, and bounded-knapsack dynamic programming over the
lengths still available closes the gap. Then so many documents of each length are picked by a
seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.llm.common import as_row, from_row, word_count
from nearkin.session import discard, materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 7
# Largest gap in words that is closed by dynamic programming; a wider one is narrowed greedily first,
# and narrowing ends where the gap is small enough to leave the programming a choice of lengths.
GAP = 1 << 16
RESERVE = 1 << 12
# Documents per bucket when picking: groups of one length are cut into ranges of the hash.
BUCKET = 1024


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to ``source, source_size`` (one row per source).

    Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times all
    sizes. No target exceeds ``most`` times its source's size: the excess goes to the others by
    weight until none is above. That is the water level ``v`` with sum(min(cap, v * weight)) = budget.
    """
    # One row per source: these windows order a table of sources, not of documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.select("source", "source_size", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)).alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    budget = F.sum("source_size").over(everything) * share
    levels = ranked.select("*", ((budget - below) / weight_left).alias("level"))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    level = F.min_by(F.when(fits, F.col("level")), F.when(fits, F.col("cap") / F.col("weight"))).over(everything)
    levels = levels.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    return levels.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _hashed(*key: object) -> float:
    """A number from 0 to 1 that depends on the key alone."""
    return xxhash.xxh64_intdigest("/".join(map(repr, key)), SEED) / 2.0**64


def _close(sizes: np.ndarray, free: np.ndarray, gap: int, order: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of each size to add so that ``gap`` is met or nearly, and what is left of it."""
    # Bit s of `reached` is set if the sum s can be made of the items so far.
    reached, mask, steps = 1, (1 << (gap + 1)) - 1, []
    for i in order:
        size = int(sizes[i])
        if not 0 < size <= gap or reached >> gap & 1:
            continue
        some, many = min(int(free[i]), gap // size), 1
        while some > 0 and not reached >> gap & 1:
            many = min(many, some)
            steps.append((int(i), many, reached))
            reached |= reached << size * many & mask
            some -= many
            many *= 2
    met = left = reached.bit_length() - 1
    added = np.zeros(len(sizes), dtype=np.int64)
    for i, many, before in reversed(steps):
        if not before >> left & 1:
            added[i] += many
            left -= int(sizes[i]) * many
    return added, gap - met


def fill_budget(sizes: list[int], counts: list[int], budget: int, seed: int = SEED, source: str | None = None) -> list[int]:
    """How many documents of each size to take so that their sizes add up to ``budget``.

    At most ``counts`` of each. Exact if the lengths left over for the gap allow it, else the nearest
    sum below that they reach. Remainders are added up from short to long, starting at a seeded place,
    and each whole number passed takes one more document, so that any range of lengths gets its share.
    """
    sizes_, counts_ = np.array(sizes, dtype=np.int64), np.array(counts, dtype=np.int64)
    total = int((sizes_ * counts_).sum())
    if budget >= total:
        return counts_.tolist()
    part = counts_ * (budget / total)
    taken = np.where(sizes_ > 0, np.floor(part), 0).astype(np.int64)
    by_size = np.argsort(sizes_)
    passed = np.floor(_hashed(seed, source) + np.cumsum(np.where(sizes_ > 0, part - taken, 0)[by_size]))
    more = np.zeros(len(sizes_), dtype=bool)
    more[by_size] = np.diff(passed, prepend=0) > 0
    more &= (sizes_ > 0) & (taken < counts_)
    # No length goes before another but by its hash.
    order = np.argsort([_hashed(seed, source, int(size)) for size in sizes_])
    chosen = [int(i) for i in order if more[i]]
    taken += more
    gap = budget - int((taken * sizes_).sum())
    given = 0
    while gap < 0:
        taken[chosen[given]] -= 1
        gap += int(sizes_[chosen[given]])
        given += 1
    for i in order:
        if gap <= RESERVE:
            break
        if 0 < sizes_[i] <= gap and taken[i] < counts_[i]:
            taken[i] += 1
            gap -= int(sizes_[i])
    if gap > GAP:
        for i in np.argsort(-sizes_):
            if 0 < sizes_[i] <= gap:
                free = min(int(counts_[i] - taken[i]), gap // int(sizes_[i]))
                taken[i] += free
                gap -= free * int(sizes_[i])
    added, left = _close(sizes_, counts_ - taken, min(gap, GAP), order)
    best, least = taken + added, left
    # A gap that cannot be met is widened: documents go back, by hash, until the rest can meet it.
    back = 1
    while least and given < len(chosen) and gap <= RESERVE:
        for i in chosen[given : given + back]:
            taken[i] -= 1
            gap += int(sizes_[i])
        given, back = given + back, back * 2
        if gap <= GAP:
            added, left = _close(sizes_, counts_ - taken, gap, order)
            if left < least:
                best, least = taken + added, left
    return best.tolist()


def _plan(pdf: pd.DataFrame, seed: int) -> pd.DataFrame:
    size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    passes = int(target // size) if size else 0
    pdf = pdf.sort_values("size").copy()
    pdf["passes"] = passes
    budget, source = round(target - passes * size), pdf["source"].iloc[0]
    source = None if pd.isna(source) else str(source)
    pdf["extra"] = fill_budget(pdf["size"].tolist(), pdf["docs"].tolist(), budget, seed, source) if size else 0
    return pdf[["source", "size", "docs", "source_size", "target", "passes", "extra"]]


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join that also matches nulls."""
    right = right.select(*[F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(right, on).drop(*[f"_{k}" for k in keys])


def _row_hash(docs: DataFrame, seed: int) -> Column:
    hashable = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(seed), *hashable)


def picks(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``doc_id, row_hash, size, source_size, target, times`` for every row of ``docs``.

    ``times`` says how often the mix takes the document, at most ``most`` times. The words taken of a
    source come within one document of its target, and mostly meet it exactly. A null or empty text
    has size zero and is taken as often as there are whole passes; a null ``source`` is a source of
    its own, the last one. Picks depend on rows alone, so reruns agree; among identical rows any may
    be picked. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("source").alias("source"), word_count(F.col("text")).alias("size"), _row_hash(docs, seed).alias("row_hash"))
    rows = materialize(rows, "mix-sizes")
    lengths = materialize(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mix-lengths")
    aims = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, share, most)
    kind = dict(docs.dtypes)["source"]
    schema = f"source {kind}, size bigint, docs bigint, source_size bigint, target double, passes int, extra bigint"
    # A group is one source's distinct lengths: at most the root of twice its words.
    plan = materialize(_same(lengths, aims, ["source"]).groupBy("source").applyInPandas(lambda pdf: _plan(pdf, seed), schema), "mix-plan")
    discard(lengths)

    # Documents of one length are picked by hash. A group is cut into hash ranges of about BUCKET
    # rows, so that only the range on the border has to be ordered, and no group is gathered.
    spread = F.shiftrightunsigned("row_hash", 33)
    ranges = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET))
    bucket = F.floor(spread * ranges / float(1 << 31)).cast("bigint")
    planned = _same(rows, plan, ["source", "size"]).withColumn("bucket", bucket)
    keys = ["source", "size", "bucket"]
    counts = planned.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("row_hash", "doc_id"))
    picked = (F.col("before") + place <= F.col("extra")).cast("int")
    placed = _same(planned, counts, keys)
    return placed.select("doc_id", "row_hash", "size", "source_size", "target", (F.col("passes") + picked).alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows identical in all columns are taken equally often.
    """
    found = picks(docs, weights, share, most, seed).groupBy("row_hash").agg(F.round(F.avg("times")).cast("int").alias("copies"))
    rows = docs.select(as_row(docs).alias("document"), _row_hash(docs, seed).alias("row_hash"))
    taken = rows.join(found.where("copies > 0"), "row_hash")
    return from_row(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), "document", docs.columns)
