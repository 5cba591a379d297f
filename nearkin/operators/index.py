"""l-mer and chunk indexes, their frequencies, and what is derived from them.

A sample is a set of rows ``(sample, id, seq)``; functions take the column names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.functions.encode import counted_lmers, equal_chunks, lmer_set, lmers, slices
from nearkin.operators.graph import number_in_order
from nearkin.session import materialize, spread

# Bits of a word of samples.
WORD = 64
# Blocks of samples where every pair of samples is a result.
PAIR_BLOCKS = 16


def lmer_rows(df: DataFrame, seq: str, l: int, keep: list[str]) -> DataFrame:
    """Every l-mer with its 0-based position."""
    return df.select(*keep, F.posexplode(lmers(seq, l)).alias("pos", "lmer"))


def lmer_index(df: DataFrame, seq: str, l: int, keep: list[str]) -> DataFrame:
    """Inverted index as postings: each distinct l-mer of a row, once. Tasks are as many as the strings need."""
    rows = spread(df.select(*keep, F.col(seq).alias("_seq")), "_seq")
    return rows.select(*keep, F.explode(lmer_set("_seq", l)).alias("lmer"))


def distinct_lmers(df: DataFrame, seq: str, l: int, by: list[str]) -> DataFrame:
    """Distinct l-mers of all rows of a group; those of some megabytes of rows are made distinct before they are rows."""
    if l < 1:
        return lmer_index(df, seq, l, by).distinct()
    rows = df.select(*by, F.col(seq).alias("_seq"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(by))
            for i, j in slices(texts):
                some = batch.slice(i, j - i)
                numbers: dict = {}
                names = zip(*(some.column(c).to_pylist() for c in range(len(by)))) if by else [()] * len(some)
                groups = np.array([numbers.setdefault(repr(n), (len(numbers), at))[0] for at, n in enumerate(names)], dtype=np.int64)
                of, grams, _ = counted_lmers([t or "" for t in some.column(len(by)).to_pylist()], groups, l)
                at = pa.array(np.array([at for _, at in numbers.values()], dtype=np.int64)[of])
                yield pa.RecordBatch.from_arrays([*(some.column(c).take(at) for c in range(len(by))), pa.array(grams, pa.string())], [*by, "lmer"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_seq"] + ["lmer string"])
    return rows.mapInArrow(found, schema).distinct()


def chunk_rows(df: DataFrame, chunks: Column, keep: list[str]) -> DataFrame:
    """Fixed-position chunks with their chunk number."""
    return df.select(*keep, F.posexplode(chunks).alias("pos", "chunk"))


def positional_index(df: DataFrame, chunks: Column, by: list[str]) -> DataFrame:
    """Number of rows behind each (position, chunk); the postings are :func:`chunk_rows`."""
    return chunk_rows(df, chunks, by).groupBy(*by, "pos", "chunk").agg(F.count(F.lit(1)).alias("freq"))


def position_sets(df: DataFrame, chunks: Column, by: list[str]) -> DataFrame:
    """Distinct chunks seen at each position."""
    return chunk_rows(df, chunks, by).distinct()


def lmer_frequency(df: DataFrame, seq: str, l: int, by: list[str] = []) -> DataFrame:
    """Posting-list size: how many rows contain each l-mer."""
    return lmer_index(df, seq, l, by).groupBy(*by, "lmer").agg(F.count(F.lit(1)).alias("freq"))


def index_metadata(df: DataFrame, seq: str, l: int, by: list[str]) -> DataFrame:
    """Per sample: number of strings, longest string, and chunks in that string."""
    meta = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("sequences"), F.max(F.length(seq)).alias("sequences_length")
    )
    return meta.withColumn("chunks_count", F.floor(F.col("sequences_length") / l).cast("int"))


def ranked_chunks(probes: DataFrame, frequencies: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Chunks of each row from rarest to most frequent, ties by position.

    ``probes`` has ``(key, pos)`` and the ``on`` columns, ``frequencies`` the ``on`` columns and
    ``freq``. Chunks without a frequency (absent on the other side) drop out. A window group is
    one row's chunks, so its size is bounded by the length of one string.
    """
    order = Window.partitionBy(key).orderBy("freq", "pos")
    # Spark sees the size of the table the frequencies come from, not theirs: no broadcast.
    return probes.join(frequencies.hint("merge"), on).withColumn("rank", F.row_number().over(order))


def rarest_chunks(ranked: DataFrame, key: str, hits: Column) -> DataFrame:
    """The chunks that suffice to find every partner sharing at least ``hits`` of them.

    Of ``n`` present chunks a partner misses at most ``n - hits``, so it owns one of the
    ``n - hits + 1`` rarest.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return ranked.withColumn("n", n).where(F.col("rank") <= F.col("n") - hits + 1)


def _sample_words(df: DataFrame, sample: str) -> DataFrame:
    """``(sample, num, word, bit)``: samples numbered in their order, and the place of each in words of bits."""
    known = df.select(sample).where(F.col(sample).isNotNull()).distinct()
    num = number_in_order(known, sample, "num")
    return materialize(num.select(F.col(sample).alias("sample"), "num", F.floor(F.col("num") / WORD).cast("int").alias("word"), (F.col("num") % WORD).alias("bit")), "samples")


def sample_coincidences(df: DataFrame, sample: str, seq: str, l: int) -> DataFrame:
    """For each ordered pair of samples: positions of the first holding a chunk of the second.

    The samples that hold an l-mer are bits of 64-bit words. A chunk meets words, the chunks at one position
    of a sample are joined by OR, and bits are counted over positions, so an l-mer in every one of ``s``
    samples makes ``s / 64`` rows for each place that holds it, not ``s``. Pairs without a shared l-mer
    are absent (coincidence 0), as are rows without a sample.
    """
    samples = _sample_words(df, sample)
    named = df.select(F.col(sample).alias("sample"), F.col(seq).alias("seq"))
    left = position_sets(named, equal_chunks("seq", l), ["sample"]).join(samples, "sample")
    left = left.select(F.col("sample").alias("sample1"), F.col("num").alias("num1"), F.col("word").alias("word1"), "pos", F.col("chunk").alias("lmer"))
    bit = F.expr("shiftleft(1L, bit)")
    right = distinct_lmers(named, "seq", l, ["sample"]).join(samples, "sample").groupBy("lmer", "word").agg(F.bit_or(bit).alias("bits"))
    # Spark sees the size of the table the l-mers come from, not theirs: no broadcast. Only later samples count.
    met = left.join(right.hint("merge"), "lmer").where("word >= word1")
    placed = met.groupBy("sample1", "num1", "word", "pos").agg(F.bit_or("bits").alias("bits"))
    counts = placed.groupBy("sample1", "num1", "word").agg(F.array(*(F.sum(F.getbit("bits", F.lit(n))) for n in range(WORD))).alias("counts"))
    found = counts.select("sample1", "num1", "word", F.posexplode("counts").alias("bit", "coincidences")).where("coincidences > 0")
    found = found.withColumn("num2", F.col("word") * WORD + F.col("bit")).where("num2 > num1")
    second = samples.select(F.col("sample").alias("sample2"), F.col("num").alias("num2"))
    return found.join(second, "num2").select("sample1", "sample2", F.col("coincidences").cast("int").alias("coincidences"))


def related_samples(df: DataFrame, sample: str, seq: str, l: int, k: int) -> DataFrame:
    """Sample pairs whose coincidences allow a pair of strings within ``k``.

    The string with the fewest chunks sets a sample's threshold. Where that is zero or less, no
    coincidence is needed, and the sample is paired with every other one.
    """
    chunks = F.floor(F.length(seq) / l).cast("int")
    fewest = df.groupBy(F.col(sample).alias("sample1")).agg(F.min(chunks).alias("fewest"))
    met = materialize(sample_coincidences(df, sample, seq, l), "coincidences")
    found = met.join(fewest, "sample1").where(F.col("coincidences") >= F.col("fewest") - k).drop("fewest")
    free = fewest.where(F.col("fewest") <= k).select("sample1")
    # All pairs of these are part of the result; blocks spread them over the tasks.
    others = fewest.select(F.col("sample1").alias("sample2"), F.pmod(F.xxhash64("sample1"), F.lit(PAIR_BLOCKS)).cast("int").alias("block"))
    spread = free.select("sample1", F.explode(F.sequence(F.lit(0), F.lit(PAIR_BLOCKS - 1))).alias("block"))
    every = spread.join(others, "block").where(F.col("sample1") < F.col("sample2")).join(met, ["sample1", "sample2"], "left")
    every = every.select("sample1", "sample2", F.coalesce("coincidences", F.lit(0)).alias("coincidences"))
    return found.join(free, "sample1", "left_anti").unionByName(every)
