"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words of a text, pairs of neighbours and pairs with one or two words between them, in
lower case and without punctuation, each present or not. They are hashed to 44 bits, where chance
collisions with a weighted feature stay rare even in texts of millions of words. Training rates are
per coordinate and the L1 term keeps the weights of rare features at zero, so what is left is small
enough to send to every task whatever the size of the corpus.

The model is fitted on a sample of labelled rows of bounded expected size. The sample is cut into shards, each
trained in a task of its own; the shards' weights are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import map_batches

# Expected number of labelled rows to train on, and of rows in a shard.
SAMPLE = 24_000
SHARD_ROWS = 4_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.5
# A missed toxic document counts as much as so many clean ones taken for toxic.
POSITIVE_WEIGHT = 3.0
BITS = 44
CUT = 0.3
BIAS = 0
_PUNCTUATION = bytes.maketrans(bytes(range(128)), bytes(c if chr(c).isalnum() else 32 for c in range(128)))
_KINDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
_PAIR = np.uint64(0xBF58476D1CE4E5B9)
# Words of a text whose features are made at once.
_SPAN = 1 << 16


def _spans(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text in spans of words, repeats included."""
    words = text.lower().encode("utf-8", "replace").translate(_PUNCTUATION).split()
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    for at in range(0, len(ids), _SPAN):
        span = ids[at : at + _SPAN + 3]
        made = [span[:_SPAN] * _KINDS[0]]
        mixed = (span * _PAIR) ^ (span >> np.uint64(31))
        for gap in (1, 2, 3):
            made.append((mixed[:-gap] + span[gap:]) * _KINDS[gap])
        yield (np.concatenate(made) >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """The distinct feature numbers of a text, in order; the first is the bias."""
    return np.unique(np.concatenate([np.array([BIAS]), *_spans(text)]))


@dataclass(frozen=True)
class Weights:
    """The features with a weight, in order, and their weights."""

    ids: np.ndarray
    values: np.ndarray

    def table(self) -> np.ndarray:
        """Marks the low bits of the weighted features, to pass over most others quickly."""
        marks = np.zeros(1 << 20, dtype=bool)
        marks[self.ids & ((1 << 20) - 1)] = True
        return marks

    def score(self, text: str, marks: np.ndarray) -> float:
        low = (1 << 20) - 1
        found = [np.array([BIAS]), *(span[marks[span & low]] for span in _spans(text))]
        found = np.unique(np.concatenate(found))
        at = np.minimum(np.searchsorted(self.ids, found), max(len(self.ids) - 1, 0))
        total = self.values[at][self.ids[at] == found].sum() if len(self.ids) else 0.0
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35.0, 35.0))))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows in the order given."""
    rows = [features(t) for t in texts]
    ids, columns = np.unique(np.concatenate(rows), return_inverse=True)
    ends = np.cumsum([len(r) for r in rows])
    z, n = np.zeros(len(ids)), np.zeros(len(ids))
    for _ in range(epochs):
        for row, end, label in zip(rows, ends, labels):
            at = columns[end - len(row) : end]
            zi, ni = z[at], n[at]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
            gradient *= POSITIVE_WEIGHT if label else 1.0
            square = gradient * gradient
            z[at] = zi + gradient - (np.sqrt(ni + square) - root) / ALPHA * w
            n[at] = ni + square
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    kept = w != 0
    return Weights(ids[kept], w[kept])


def _train_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["place", "text"])
    weights = train(pdf["text"].tolist(), pdf["label"].tolist())
    return pd.DataFrame({"id": weights.ids, "weight": weights.values})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> Weights:
    """Weights from labelled documents; ``labels`` has ``doc_id`` and ``label`` (0 or 1).

    Rows with a null id or label are not used; of several labels of a document the greatest counts.
    About ``sample`` rows are used, taken by a hash of ``doc_id``. Without any rows all weights
    are zero and every score is one half.
    """
    known = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("label").alias("label"))
    total = known.count()
    shards = max(1, round(min(sample, total) / shard_rows))
    place = F.pmod(F.xxhash64(F.lit(11), "_id"), F.lit(1 << 30))
    chosen = known.withColumn("place", place).where(F.col("place") < int((1 << 30) * min(1.0, sample / max(total, 1))))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(chosen, "_id")
    rows = rows.select("text", F.col("label").cast("int").alias("label"), "place", (F.col("place") % shards).alias("shard"))
    trained = rows.groupBy("shard").applyInPandas(_train_shard, "id bigint, weight double")
    # Weighted features of a bounded sample: few rows, whatever the size of the corpus.
    averaged = trained.groupBy("id").agg(F.sum("weight").alias("weight")).toPandas().sort_values("id")
    return Weights(averaged["id"].to_numpy(dtype=np.int64), averaged["weight"].to_numpy(dtype=float) / shards)


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the probability of label 1.

    An empty or null text has the score of the bias alone. Only ``text`` decides a score; ``doc_id`` is
    passed on, null or repeated as it may be. An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    tables: list[np.ndarray] = []

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not tables:
            tables.append(shared.value.table())
        scores = [shared.value.score(t.as_py() or "", tables[0]) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, score double")
