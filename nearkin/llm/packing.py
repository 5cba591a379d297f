"""Token ids packed into rows of fixed length by best-fit decreasing.

Each task tokenizes its documents and packs them window by window; a window is a bounded number of
tokens, so memory does not depend on the partition and nothing is shuffled. A document ends with
the separator; one longer than a row is cut into pieces, none of which is dropped. Inside a window,
pieces go from long to short, each into the row with the least room that still fits. A segment tree
over the amounts of room finds that row in logarithmic time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import BLOCK_BYTES, encode_whole

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# The id after the vocabulary's last one: ends a document and fills what is left of a row.
SEPARATOR = 50256
LENGTH = 2048
# Tokens packed together. More would fill rows a little better and take more memory.
WINDOW = 4_000_000
SCHEMA = (
    "shard int, row int, n_tokens int, doc_ids array<bigint>, pieces array<int>, "
    "cu_seqlens array<int>, token_ids binary, position_ids binary"
)


@dataclass(frozen=True)
class Vocabulary:
    """Byte-level BPE ranks and the pattern that cuts a text into pieces to merge in."""

    ranks: bytes
    pattern: str

    @staticmethod
    def read(path: str = VOCABULARY, pattern: str | None = None) -> Vocabulary:
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as file:
            return Vocabulary(file.read(), pattern)

    def encoding(self):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
        return tiktoken.Encoding("documents", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})


class RoomTree:
    """Which amounts of room (0 to ``size``) some row has: set, clear, least amount from a bound on."""

    def __init__(self, size: int):
        self.leaves = 1 << max(size, 1).bit_length()
        self.some = bytearray(2 * self.leaves)

    def mark(self, room: int, has: bool) -> None:
        node = room + self.leaves
        self.some[node] = has
        while node > 1:
            node //= 2
            value = self.some[2 * node] | self.some[2 * node + 1]
            if self.some[node] == value:
                break
            self.some[node] = value

    def least_from(self, room: int) -> int | None:
        node = room + self.leaves
        if self.some[node]:
            return room
        while node > 1:
            if not node & 1 and self.some[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def best_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of item numbers; no row's sizes exceed ``length``. Items are placed from large to small."""
    rows: list[list[int]] = []
    with_room: dict[int, list[int]] = {}
    tree = RoomTree(length)
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.least_from(sizes[item])
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = with_room[room].pop()
            if not with_room[room]:
                tree.mark(room, False)
        rows[row].append(item)
        left = room - sizes[item]
        with_room.setdefault(left, []).append(row)
        if len(with_room[left]) == 1:
            tree.mark(left, True)
    return rows


def _encode(encoding, text: str) -> np.ndarray:
    return np.append(encode_whole(encoding, text), SEPARATOR).astype("<u2")


def _pack(items: list[tuple[int | None, int, np.ndarray]], length: int, shard: int, first_row: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit([len(ids) for _, _, ids in items], length)
    per_batch = max(1, BLOCK_BYTES // (4 * length))
    for at in range(0, len(rows), per_batch):
        part = rows[at : at + per_batch]
        columns: list[list] = [[] for _ in range(8)]
        for n, members in enumerate(part):
            ids = [items[m][2] for m in members]
            sizes = [len(x) for x in ids]
            used = sum(sizes)
            tokens = np.full(length, SEPARATOR, dtype="<u2")
            tokens[:used] = np.concatenate(ids)
            places = np.zeros(length, dtype="<u4")
            places[:used] = np.concatenate([np.arange(s, dtype="<u4") for s in sizes])
            ends = [0, *np.cumsum(sizes).tolist()]
            values = (shard, first_row + at + n, used, [items[m][0] for m in members], [items[m][1] for m in members], ends, tokens.tobytes(), places.tobytes())
            for column, value in zip(columns, values):
                column.append(value)
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        names = ["shard", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", "token_ids", "position_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def pack(docs: DataFrame, vocabulary: Vocabulary | None = None, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Packed rows of the documents' token ids.

    ``shard`` (the task) and ``row`` name a row; ``token_ids`` has ``length`` little-endian 16-bit
    ids, of which ``n_tokens`` are in use and the others separators; ``position_ids`` (32 bits)
    restarts at 0 with every segment; ``cu_seqlens`` has the segments' bounds. Segment ``i`` is piece
    ``pieces[i]`` of document ``doc_ids[i]``; a document's pieces in order, without the separator at
    the end, decode to its text. An empty or null text is a separator alone; a null ``doc_id`` stays
    null; repeated documents are packed as often as they come; an empty table gives no rows.
    Retried tasks make the same rows. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, shard, row = shared.value.encoding(), TaskContext.get().partitionId(), 0
        items: list[tuple[int | None, int, np.ndarray]] = []
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = _encode(encoding, text.as_py() or "")
                items += [(doc_id, i // length, ids[i : i + length]) for i in range(0, len(ids), length)]
                held += len(ids)
                if held >= window:
                    for packed in _pack(items, length, shard, row):
                        row += packed.num_rows
                        yield packed
                    items, held = [], 0
        yield from _pack(items, length, shard, row)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """``doc_id, text`` of packed rows, for documents whose ids are unique and not null."""
    shared = packed.sparkSession.sparkContext.broadcast(vocabulary or Vocabulary.read())
    bounds = F.transform(
        F.sequence(F.lit(0), F.size("doc_ids") - 1),
        lambda i: F.struct(F.get("doc_ids", i).alias("doc_id"), F.get("pieces", i).alias("piece"), F.get("cu_seqlens", i).alias("a"), F.get("cu_seqlens", i + 1).alias("b")),
    )
    segments = packed.select("token_ids", F.explode(bounds).alias("s")).select(
        "s.doc_id", F.struct("s.piece", F.expr("substring(token_ids, s.a * 2 + 1, (s.b - s.a) * 2)").alias("ids")).alias("part")
    )
    whole = segments.groupBy("doc_id").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = shared.value.encoding()
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u2")[:-1].tolist() for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encoding.decode(x) for x in ids], pa.string())], ["doc_id", "text"])

    return whole.mapInArrow(run, "doc_id bigint, text string")
