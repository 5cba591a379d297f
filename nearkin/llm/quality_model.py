"""Quality classifier: regularised quadratic discriminant over document statistics.

Each class is a normal density over transformed statistics of a text. Class covariances are shrunk
towards the pooled one and that towards its diagonal, so they stay invertible whatever the data.
The score is the logistic of the difference of the log-densities plus the log prior odds; distances
are taken with the Cholesky factors kept in the model.

Statistics are made once and written. Fitting adds up counts, sums and products per class over all
labelled rows, which are partial sums of fixed size.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import map_batches, text_bytes
from nearkin.session import materialize

CUT = 0.3
# Weight of the pooled covariance in each class's, and of the diagonal in the pooled one.
SHRINK = 0.2
DIAGONAL = 0.1
_SYMBOLS = b"#*$%&|<>{}[]=_~^\\"
_PUNCTUATION = b".,;:!?"
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
NAMES = (
    "words", "word_bytes", "symbols", "punctuation", "exclaimed", "upper", "digits",
    "distinct", "adjacent", "commonest", "line_words", "line_copies", "compressed",
)
# Bytes of a text compressed for the last statistic are spread over the whole text in pieces this long.
_PIECE = 4096


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text, in the order of ``NAMES``; all finite."""
    words = text.split()
    n, size = len(words), len(text)
    lines = [line for line in text.split(b"\n") if line.strip()]
    counts = Counter(words)
    share = lambda part, whole: part / whole if whole else 0.0
    dense = lambda part, whole: float(np.log(1e-3 + share(part, whole)))
    drop = lambda chars: size - len(text.translate(None, chars))
    packed = sum(len(zlib.compress(text[i : i + _PIECE], 1)) for i in range(0, size, _PIECE))
    return [
        float(np.log1p(n)),
        float(np.log1p(share(sum(map(len, words)), n))),
        dense(drop(_SYMBOLS), size),
        dense(drop(_PUNCTUATION), size),
        dense(drop(b"!"), size),
        dense(drop(_UPPER), size),
        dense(drop(_DIGITS), size),
        float(np.log1p(share(len(counts), n) * 100)),
        dense(sum(a == b for a, b in zip(words, words[1:])), n),
        dense(max(counts.values(), default=0), n),
        float(np.log1p(share(n, len(lines)))),
        dense(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(share(packed, size) * 10)),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row of ``docs``; null texts count as empty."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        stats = pa.array([statistics(t) for t in text_bytes(batch.column(1))], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), stats], ["doc_id", "stats"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, stats array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Per class: mean, inverse of the Cholesky factor, log determinant; the prior log odds."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        density = []
        for mean, whiten, log_det in zip(self.means, self.whiten, self.log_det):
            distance = (((stats - mean) @ whiten.T) ** 2).sum(axis=1)
            density.append(-0.5 * (distance + log_det))
        return 1.0 / (1.0 + np.exp(-np.clip(density[1] - density[0] + self.log_odds, -35.0, 35.0)))


def discriminant(count: np.ndarray, total: np.ndarray, product: np.ndarray, shrink: float = SHRINK, diagonal: float = DIAGONAL) -> Discriminant:
    """The model from each class's row count, sums and sums of products.

    A class without rows takes the place of the other; without any rows every score is one half.
    """
    d = total.shape[1]
    rows = np.maximum(count, 1)[:, None]
    everything = total.sum(axis=0) / max(count.sum(), 1)
    means = np.where(count[:, None] > 0, total / rows, everything)
    scatter = product - count[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / max(count.sum() - 2, 1)
    spread = np.diag(np.maximum(np.diag(pooled), 1e-6))
    pooled = (1 - diagonal) * pooled + diagonal * spread
    whiten, log_det = [], []
    for k in (0, 1):
        own = scatter[k] / max(count[k] - 1, 1) if count[k] > d else pooled
        factor = np.linalg.cholesky((1 - shrink) * own + shrink * pooled + 1e-6 * spread)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    odds = float(np.log((count[1] + 1) / (count[0] + 1)))
    return Discriminant(means, np.array(whiten), np.array(log_det), odds)


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Model from ``stats`` and ``labels`` (``doc_id, label``); null ids and labels are not used.

    Of several labels of a document the greatest counts.
    """
    d = len(NAMES)
    known = labels.where("doc_id is not null and label is not null").groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("label").alias("label"))
    rows = stats.join(known, F.col("doc_id") == F.col("_id")).select(F.col("label").cast("int").alias("label"), "stats")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            label = batch.column(0).to_numpy()
            x = np.array(batch.column(1).flatten().to_numpy()).reshape(-1, d)
            for k in (0, 1):
                part = x[label == k]
                sums[k] += np.concatenate([[len(part)], part.sum(axis=0), (part.T @ part).ravel()])
        values = [pa.array([k] * sums.shape[1]) for k in (0, 1)]
        place = pa.array(np.arange(sums.shape[1]))
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([values[k], place, pa.array(sums[k])], ["label", "place", "value"])

    added = rows.mapInArrow(moments, "label bigint, place bigint, value double").groupBy("label", "place").agg(F.sum("value").alias("value"))
    sums = np.zeros((2, 1 + d + d * d))
    for row in added.collect():  # two classes of fixed size
        sums[row["label"], row["place"]] = row["value"]
    return discriminant(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` for every row of ``stats``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.array(batch.column(1).flatten().to_numpy()).reshape(-1, len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    return map_batches(stats.select("doc_id", "stats"), run, "doc_id bigint, score double")


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``: the probability of label 1.

    Only ``text`` decides a score: empty and null texts have the score of their statistics, all
    zero. ``doc_id`` is passed on, null or repeated as it may be; an empty table gives no rows.
    """
    stats = materialize(document_statistics(docs), "quality-statistics")
    return score(stats, fit(stats, labels))
