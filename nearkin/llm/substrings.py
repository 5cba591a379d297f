"""Removal of repeated byte strings, by bucket-pointer refinement of sampled positions.

Texts are compared as UTF-8 bytes. A window (100 bytes) is repeated if the same bytes start earlier:
in a document of smaller id, or earlier in the same document. All bytes under repeated windows go.

Positions are sorted into buckets by the 32-byte gram that starts there. Bucket identifiers of 2, 4,
... bytes are combined with those at later offsets, so every doubling reuses the one before. Sorting
every position of a corpus is out of reach, so each window is represented by the position of its
smallest bucket identifier, its anchor: equal windows have their anchors at equal offsets. A
run of windows with one anchor is a segment, about 30 bytes further on than the last.

1. Buckets of one anchor are done: none of their windows is repeated.
2. The other buckets are refined by the bytes around the anchor. In a bucket of equal segments all but
   the first are repeated as a whole, so only the first goes on.
3. Where a bucket still holds different segments, they are refined down to single windows.

Identity in steps 2 and 3 takes 128 bits of hashes. Every step groups or joins rows of fixed width by
key with partial minima, so a passage in a third of all documents is reduced where it lies, and
joins leave hot keys to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import blocks, map_batches, signed, text_bytes
from nearkin.session import discard, materialize

LENGTH = 100
GRAM = 32
# Bytes of text whose positions are sorted at once; a longer text is cut into overlapping pieces.
PIECE = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def bucket_ids(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Identifier of the ``gram``-byte bucket of every position; ``gram`` is a power of two."""
    ids = data.astype(np.uint64)
    size = 1
    while size < gram:
        mixed = ids[:-size] * _A
        mixed ^= mixed >> np.uint64(32)
        ids = mixed + ids[size:] * _B
        size *= 2
    ids ^= ids >> np.uint64(29)
    ids *= _C
    ids ^= ids >> np.uint64(32)
    return ids


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, bytes]]:
    """``(row, offset, bytes)``: texts cut so that every window lies in exactly one piece."""
    for row, text in enumerate(texts):
        step = PIECE - length + 1
        for start in range(0, max(len(text) - length + 1, 0), step):
            yield row, start, text[start : start + PIECE]


def segments(texts: list[bytes], length: int = LENGTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[], list[int]]]]:
    """Segments of the texts, a block of texts at a time.

    Yields ``row, start, windows, bucket`` and a function for hashes of the segments' bytes and anchor's places.
    """
    pieces = list(_pieces(texts, length))
    for first, last in blocks([len(p[2]) for p in pieces], PIECE):
        part = pieces[first:last]
        joined = b"".join(p[2] for p in part)
        sizes = np.array([len(p[2]) for p in part])
        ids = bucket_ids(np.frombuffer(joined, dtype=np.uint8))
        places = np.arange(len(ids), dtype=np.uint64)
        anchors = (_sliding_min((ids & ~_POSITION) | places, length - GRAM + 1) & _POSITION).astype(np.int64)
        owner = np.repeat(np.arange(len(part)), sizes)[: len(anchors)]
        ends = np.cumsum(sizes)
        starts = np.flatnonzero(np.arange(len(anchors)) + length <= ends[owner])
        mine = anchors[starts]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = (mine[1:] != mine[:-1]) | (starts[1:] != starts[:-1] + 1)
        cut = np.flatnonzero(new)
        low, windows = starts[cut], np.diff(np.append(cut, len(starts)))
        offset = mine[cut] - low
        own = owner[low]
        begins = np.array([p[1] for p in part])[own] - (ends - sizes)[own]
        rows = np.array([p[0] for p in part])[own]

        def contents() -> list[int]:
            spans = zip(low.tolist(), (low + windows + length - 1).tolist(), offset.tolist())
            return [xxhash.xxh3_64_intdigest(joined[a:b], o) for a, b, o in spans]

        yield rows, low + begins, windows, ids[mine[cut]], contents


def _bucket_counts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for _, _, _, bucket, _ in segments(text_bytes(batch.column(1))):
        ids, counts = np.unique(bucket, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), pa.array(counts)], ["bucket", "size"])


def _segment_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    docs = batch.column(0).to_numpy(zero_copy_only=False)
    last, seen = -1, set()
    for rows, start, windows, bucket, contents in segments(text_bytes(batch.column(1))):
        numbers = contents()
        content = np.array(numbers, dtype=np.uint64)
        again = []
        for row, id_ in zip(rows.tolist(), numbers):
            if row != last:
                last, seen = row, set()
            again.append(id_ in seen)
            seen.add(id_)
        columns = [signed(bucket), signed(content), docs[rows], start, windows.astype(np.int32), np.array(again, dtype=bool)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "content", "doc", "start", "windows", "again"])


def _window_digests(data: bytes, windows: int) -> list[bytes]:
    return [xxhash.xxh3_128_digest(data[i : i + LENGTH]) for i in range(windows)]


def _cut_segments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    doc, start, windows, cut, again = [], [], [], [], []
    texts = text_bytes(batch.column(1))
    for text, d, spans in zip(texts, batch.column(0).to_pylist(), batch.column(2).to_pylist()):
        seen: set[bytes] = set()
        for a, n in sorted((span["start"], span["windows"]) for span in spans):
            data = text[a : a + n + LENGTH - 1]
            digests = _window_digests(data, n)
            doc.append(d)
            start.append(a)
            windows.append(n)
            cut.append(data)
            again.append([i for i, x in enumerate(digests) if x in seen or seen.add(x)])
    columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(windows, pa.int32()), pa.array(cut, pa.binary()), pa.array(again, pa.list_(pa.int32()))]
    yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "windows", "bytes", "again"])


def _window_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    windows = batch.column(2).to_numpy()
    for a, b in blocks([int(n) for n in windows], 1 << 18):
        digests: list[bytes] = []
        for data, n in zip(batch.column(3).slice(a, b - a).to_pylist(), windows[a:b].tolist()):
            digests += _window_digests(data, n)
        ids = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
        counts = windows[a:b]
        within = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
        doc = np.repeat(batch.column(0).to_numpy()[a:b], counts)
        start = np.repeat(batch.column(1).to_numpy()[a:b], counts) + within
        columns = [np.ascontiguousarray(ids[:, 0]), np.ascontiguousarray(ids[:, 1]), doc, start]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w1", "w2", "doc", "start"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("doc"), F.col("text").alias("text"))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc, start, windows``: runs of consecutive window starts whose windows are repeated.

    ``doc`` is the ``doc_id``, the smallest number in place of null. Texts under 100 bytes, empty
    or null ones have no windows. Rows that repeat a document are the same document, whose windows
    are not earlier than their own copies. Rows that give one id different texts are not compared
    with each other, and places repeated in one of them count in all.
    """
    rows = _keyed(docs)
    buckets = map_batches(rows, _bucket_counts, "bucket bigint, size bigint").groupBy("bucket").agg(F.sum("size").alias("size"))
    shared = materialize(buckets.where("size > 1").select("bucket"), "repeats-buckets")
    # The joins below hash their small side, which spares sorting the large one.
    found = map_batches(rows, _segment_rows, "bucket bigint, content bigint, doc bigint, start bigint, windows int, again boolean")
    found = materialize(found.join(shared.hint("shuffle_hash"), "bucket"), "repeats-segments")
    discard(shared)

    # Repeats inside a document are marked already, so a content's first document is what counts.
    keys = ["bucket", "content"]
    firsts = found.where("not again").groupBy(*keys).agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.min_by("start", "doc").alias("start"), F.min("windows").alias("windows")
    )
    firsts = materialize(firsts, "repeats-contents")
    run = ["doc", "start", "windows"]
    spread = firsts.where("first < last").select(*keys, "first").hint("shuffle_hash")
    whole = found.join(spread, keys).where("doc > first or again").select(*run)
    # A content of one document only repeats inside it.
    whole = whole.unionByName(found.where("again").select(*run))
    whole = materialize(whole, "repeats-whole")
    discard(found)

    mixed = firsts.groupBy("bucket").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("bucket")
    open_ = firsts.join(mixed.hint("shuffle_hash"), "bucket").select(F.col("first").alias("doc"), F.struct("start", "windows").alias("span"))
    spans = open_.groupBy("doc").agg(F.collect_set("span").alias("spans")).hint("shuffle_hash")
    schema = "doc bigint, start bigint, windows int, bytes binary, again array<int>"
    cut = map_batches(rows.join(spans, "doc").select("doc", "text", "spans"), _cut_segments, schema)
    cut = materialize(cut, "repeats-open")
    discard(firsts)

    single = F.lit(1).alias("windows")
    inside = cut.select("doc", F.explode(F.transform("again", lambda i: F.col("start") + i)).alias("start"), single)
    windows = map_batches(cut.select("doc", "start", "windows", "bytes"), _window_rows, "w1 bigint, w2 bigint, doc bigint, start bigint")
    spread = windows.groupBy("w1", "w2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("w1", "w2", "first")
    spread = materialize(spread, "repeats-windows")
    later = windows.join(spread.hint("shuffle_hash"), ["w1", "w2"]).where("doc > first").select("doc", "start", single)
    return whole.unionByName(inside).unionByName(later)


def _strip(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    kept, runs = [], []
    for text, spans in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
        removed: list[list[int]] = []
        for start, n in sorted((s["start"], s["windows"]) for s in spans or ()):
            end = min(start + n + LENGTH - 1, len(text))
            if removed and start <= removed[-1][1]:
                removed[-1][1] = max(removed[-1][1], end)
            elif start < end:
                removed.append([start, end])
        places = [0, *(x for run in removed for x in run), len(text)]
        kept.append(b"".join(text[a:b] for a, b in zip(places[::2], places[1::2])))
        runs.append(removed)
    columns = [batch.column(0), pa.array([len(t) for t in text_bytes(batch.column(1))], pa.int64())]
    columns += [pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` for every row of ``docs``.

    ``removed`` lists the maximal removed runs as ``[start, end)`` byte offsets, ``kept`` has the
    remaining bytes. An empty or null text has neither; an empty table gives no rows; columns other
    than ``doc_id`` and ``text`` are ignored.
    """
    found = repeated_windows(docs)
    spans = found.groupBy("doc").agg(F.collect_list(F.struct("start", "windows")).alias("spans"))
    spans = materialize(spans, "repeats-spans")
    joined = _keyed(docs).withColumn("doc_id", F.when(F.col("doc") != -(1 << 63), F.col("doc"))).join(spans.hint("shuffle_hash"), "doc", "left")
    return map_batches(joined.select("doc_id", "text", "spans"), _strip, "doc_id bigint, n_bytes bigint, removed array<array<bigint>>, kept binary")
