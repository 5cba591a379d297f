"""q-gram profiles and their overlap."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions.encode import counted_lmers, lmers, slices
from nearkin.session import materialize

# Default gram length, and the whitespace run that counts as one blank.
DEFAULT_Q = 3
SPACE_RUN = r"\s+"


def grams(text: Column | str, q: int = DEFAULT_Q) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return lmers(F.regexp_replace(text, SPACE_RUN, " "), q)


def qgram_profile(df: DataFrame, key: str, text: str, q: int = DEFAULT_Q) -> DataFrame:
    """Counted q-grams in long form: ``(key, gram, cnt)``.

    The grams of one row are counted as numbers before they are rows. A key of one row is then done; counts
    are shuffled and added up for keys of several rows only.
    """
    rows = df.select(key, F.regexp_replace(text, SPACE_RUN, " ").alias("_text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column(1)):
                some = batch.slice(i, j - i)
                at, found, counts = counted_lmers([t or "" for t in some.column(1).to_pylist()], np.arange(len(some)), q)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(at)), pa.array(found, pa.string()), pa.array(counts, pa.int32())], ["_key", "gram", "cnt"])

    schema = f"_key {rows.schema[key].dataType.simpleString()}, gram string, cnt int"
    every = lambda some: some.mapInArrow(counted, schema).withColumnRenamed("_key", key)
    again = _repeated(rows, key)
    if again.isEmpty():
        return every(rows)
    same = F.col(f"x.{key}").eqNullSafe(F.col("y.again"))
    side = lambda how: every(rows.alias("x").join(again.alias("y"), same, how))
    added = side("left_semi").groupBy(key, "gram").agg(F.sum("cnt").cast("int").alias("cnt"))
    return side("left_anti").unionByName(added)


def _repeated(rows: DataFrame, key: str) -> DataFrame:
    """``again``: the keys of more than one row."""
    keys = rows.groupBy(F.col(key).alias("again")).agg(F.count(F.lit(1)).alias("rows"))
    return materialize(keys.where("rows > 1").select("again"), "repeated")


def shared_grams(left: Column | str, right: Column | str, q: int = DEFAULT_Q) -> Column:
    """How many q-grams two texts share, with multiplicity; 0 if one of them is null."""

    def codes(text: str) -> np.ndarray:
        symbols = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        ends = len(symbols) - q + 1
        return sum((symbols[i : i + ends] << 21 * (q - 1 - i) for i in range(q)), np.int64(0)) if ends > 0 else symbols[:0]

    def shared(x: str, y: str) -> int:
        if q > 3:
            return sum((Counter(x[i : i + q] for i in range(len(x) - q + 1)) & Counter(y[i : i + q] for i in range(len(y) - q + 1))).values())
        (a, m), (b, n) = (np.unique(codes(t), return_counts=True) for t in (x, y))
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        return int(np.minimum(m[i], n[j]).sum())

    @F.arrow_udf("int")
    def count(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([shared(x.as_py() or "", y.as_py() or "") for x, y in zip(xs, ys)], pa.int32())

    blank = lambda text: F.regexp_replace(text, SPACE_RUN, " ")
    return count(blank(left), blank(right))


def text_similarity(pairs: DataFrame, left: str, right: str, df: DataFrame, key: str, text: str, q: int = DEFAULT_Q) -> DataFrame:
    """The same as :func:`qgram_similarity`, from the texts: these move to their pairs, not their grams.

    Pairs of a key with several rows are left to the profiles.
    """
    pairs = pairs.select(left, right).distinct()
    texts = df.select(key, text)
    again = _repeated(texts, key)
    some = None
    if not again.isEmpty():
        marked = lambda rows, name: rows.join(again.select(F.col("again").alias(name), F.lit(True).alias(f"{name}_again")), name, "left")
        pairs = materialize(marked(marked(pairs, left), right), "pairs")
        some = pairs.where(f"{left}_again or {right}_again").select(left, right)
        pairs = pairs.where(f"{left}_again is null and {right}_again is null").select(left, right)
        wanted = some.select(F.col(left).alias(key)).union(some.select(F.col(right).alias(key))).distinct()
        some = qgram_similarity(some, left, right, qgram_profile(texts.join(wanted, key, "left_semi"), key, text, q), key)
    side = lambda name: texts.select(F.col(key).alias(name), F.col(text).alias(f"{name}_text"))
    both = pairs.join(side(left), left, "left").join(side(right), right, "left")
    found = both.select(left, right, shared_grams(f"{left}_text", f"{right}_text", q).alias("similarity"))
    return found if some is None else found.unionByName(some)


def qgram_similarity(pairs: DataFrame, left: str, right: str, profiles: DataFrame, key: str) -> DataFrame:
    """Shared q-grams with multiplicity for each given ``(left, right)`` pair of keys.

    The profiles are read once: each row's grams go to the pairs the row belongs to, on either side,
    and are then added up per (pair, gram). A gram that is common everywhere never becomes a
    key of its own. Pairs sharing nothing are kept with 0; a pair of a row with itself shares all.
    """
    pairs = pairs.select(left, right).distinct()
    side = lambda name, number: pairs.select(F.col(name).alias(key), left, right, F.lit(number).alias("side"))
    wanted = side(left, 0).unionByName(side(right, 1))
    # Spark sees the size of the texts' table, not that of the grams: no broadcast of the profiles.
    grams_of = profiles.hint("merge").join(wanted, key)
    of_side = lambda n: F.sum(F.when(F.col("side") == n, F.col("cnt")))
    shared = grams_of.groupBy(left, right, "gram").agg(F.least(F.coalesce(of_side(0), F.lit(0)), F.coalesce(of_side(1), F.lit(0))).alias("both"))
    total = shared.groupBy(left, right).agg(F.sum("both").cast("int").alias("similarity"))
    return pairs.join(total, [left, right], "left").select(left, right, F.coalesce("similarity", F.lit(0)).alias("similarity"))
