"""Tokens of two tokenizers over the same texts, aligned by the bytes they cover.

Tokenizer A (byte-level BPE) sees a space and the text, tokenizer B (SentencePiece) puts that space
there itself, so both cut the same bytes. Every document's two token lists are merged by their
ends, and all documents of a block at once: one state vector has a pointer into A and one into B
per document, each step emits every pair of tokens that the pointers show (they overlap, a *link*),
notes where both end (a *cut*), moves the pointer whose token ends first (both at a cut), and drops
the documents that are done. A long document takes part with several pointers, one for each run of
``LANE`` tokens, so it does not leave the others' steps to itself.

How many documents of the corpus link two ids is counted in two steps: each block counts its own
pairs, blocks' counts are added up by pair. The sums go back to the blocks the same way, one row for
each pair of a block, never one for each link.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import blocks, encode_whole
from nearkin.session import materialize

# Tokens of A that one pointer passes.
LANE = 256
# Bytes of text in a block; a block's tokens, links and counts are in memory together.
BLOCK_BYTES = 1 << 20
MODEL_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_SCHEMA = "block bigint, doc_ids array<bigint>, n_a array<int>, n_b array<int>, a binary, b binary, pairs array<bigint>, held array<int>"
LINK_SCHEMA = "doc_id bigint, a array<int>, b array<int>, link_a array<int>, link_b array<int>, cuts array<int>"
SUMMARY_SCHEMA = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"


def byte_symbols() -> dict[str, int]:
    """The printable symbol that stands for each byte in byte-level vocabularies, as ``symbol: byte``."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(others)}}


@dataclass(frozen=True)
class Tokenizers:
    """A's bytes by id and splitting pattern; B's serialized model and bytes by id."""

    a_bytes: list[bytes]
    a_special: frozenset[int]
    pattern: str
    b_model: bytes
    b_bytes: list[bytes]

    @staticmethod
    def read(a: str | None = None, b: str | None = None, pattern: str | None = None) -> Tokenizers:
        """From A's JSON file and B's model file. A's ids must be in the order of its merges."""
        import public_tokenizers
        import sentencepiece

        with open(a or public_tokenizers.path(MODEL_A), encoding="utf-8") as file:
            described = json.load(file)
        symbols = byte_symbols()
        special = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
        by_id = {i: bytes(symbols[s] for s in t) for t, i in described["model"]["vocab"].items() if i not in special} | special
        a_bytes = [by_id[i] for i in range(len(by_id))]
        for n, merge in enumerate(described["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            if a_bytes[256 + n] != bytes(symbols[s] for s in left + right):
                raise ValueError("ids of the byte-level tokenizer are not in the order of its merges")
        model = sentencepiece.SentencePieceProcessor(model_file=b or public_tokenizers.path(MODEL_B))
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        b_bytes = [bytes([int(p[1:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        return Tokenizers(a_bytes, frozenset(special), pattern or public_tokenizers.PATTERN, model.serialized_model_proto(), b_bytes)

    @cached_property
    def encoders(self):
        import sentencepiece
        import tiktoken

        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in self.a_special}
        a = tiktoken.Encoding("a", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return a, sentencepiece.SentencePieceProcessor(model_proto=self.b_model)

    @cached_property
    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))

    @cached_property
    def kinds(self) -> tuple[str, str]:
        """Types that ids are stored in."""
        return tuple("<u2" if len(table) <= 1 << 16 else "<u4" for table in (self.a_bytes, self.b_bytes))

    @cached_property
    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids with what follows them: inside a group, then at its end."""
        made = []
        for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";")):
            made.append(np.array([f"{i}{mark}" for mark in (",", last) for i in range(len(table))], dtype=object))
        return tuple(made)

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B for each text; none where there is no text or the tokens do not spell it."""
        a, b = self.encoders
        found = []
        for text, ids_b in zip(texts, b.encode([t or "" for t in texts], num_threads=1)):
            ids_a = encode_whole(a, f" {text}").tolist() if text else []
            whole = f" {text}".encode() if text else b""
            if b"".join([self.a_bytes[i] for i in ids_a]) != whole or b"".join([self.b_bytes[i] for i in ids_b]) != whole:
                ids_a, ids_b = [], []
            found.append((np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)))
        return found


def lockstep(sizes_a: np.ndarray, sizes_b: np.ndarray, starts: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links as places in A and in B, in order, and which of them end together.

    ``sizes`` are the byte lengths of all documents' tokens, one document after the other; ``starts``
    are the places in A where documents begin.
    """
    if not len(sizes_a):
        return (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=bool),)
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    begins = np.zeros(len(ends_a), dtype=np.int64)
    begins[starts] = starts
    i = np.flatnonzero((np.arange(len(ends_a)) - np.maximum.accumulate(begins)) % lane == 0)
    stop = np.append(i[1:], len(ends_a))
    j = np.searchsorted(ends_b, ends_a[i] - sizes_a[i], side="right")
    links_a, links_b, cuts = [], [], []
    while len(i):
        end_a, end_b = ends_a[i], ends_b[j]
        links_a.append(i)
        links_b.append(j)
        cuts.append(end_a == end_b)
        i = i + (end_a <= end_b)
        j = j + (end_b <= end_a)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    all_a = np.concatenate(links_a)
    order = np.argsort(all_a, kind="stable")
    return all_a[order], np.concatenate(links_b)[order], np.concatenate(cuts)[order]


class Block:
    """Some documents' tokens with their links."""

    def __init__(self, tables: Tokenizers, n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.tables, self.n_a, self.n_b, self.a, self.b = tables, n_a, n_b, a, b
        size_a, size_b = tables.sizes
        first = np.cumsum(n_a) - n_a
        self.link_a, self.link_b, self.cut = lockstep(size_a[a], size_b[b], first[n_a > 0])
        self.doc = np.repeat(np.arange(len(n_a)), n_a)[self.link_a]
        self.pair = a[self.link_a] * len(size_b) + b[self.link_b]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs, sorted, and how many of the documents link each."""
        held = np.unique(self.pair * max(1, len(self.n_a)) + self.doc) // max(1, len(self.n_a))
        return np.unique(held, return_counts=True)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.array(np.bincount(self.doc, weights=values, minlength=len(self.n_a))).round().astype(np.int64)

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document: the ids between cuts."""
        cut_a, cut_b = self.link_a[self.cut], self.link_b[self.cut]
        last_a, last_b = np.zeros(len(self.a), dtype=np.int64), np.zeros(len(self.b), dtype=np.int64)
        last_a[cut_a], last_b[cut_b] = 1, 1
        # A group's ids of A come behind all ids of earlier groups, its ids of B behind its own of A.
        earlier_b = np.concatenate([[0], cut_b + 1])[np.cumsum(last_a) - last_a]
        own_a = np.append(cut_a + 1, len(self.a))[np.cumsum(last_b) - last_b]
        names_a, names_b = self.tables.names
        row = np.empty(len(self.a) + len(self.b), dtype=object)
        row[np.arange(len(self.a)) + earlier_b] = names_a[self.a + last_a * len(self.tables.a_bytes)]
        row[np.arange(len(self.b)) + own_a] = names_b[self.b + last_b * len(self.tables.b_bytes)]
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return ["".join(row[s:e].tolist())[:-1] for s, e in zip([0, *ends], ends)]


def _list(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def _packed(ids: np.ndarray, kind: str) -> bytes:
    return pa.compress(ids.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: str, number: int) -> np.ndarray:
    raw = pa.decompress(packed, number * np.dtype(kind).itemsize, codec="zstd") if number else b""
    return np.frombuffer(raw, dtype=kind).astype(np.int64)


def tokenize(docs: DataFrame, tokenizers: Tokenizers | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The corpus as written blocks of about ``block_bytes`` of text: ids of A and B, and the block's own pair counts.

    Null, empty and misspelt texts have no tokens but keep their place; null and repeated ``doc_id`` and
    repeated rows are documents of their own; an empty table gives no blocks. A text larger than a
    block is a block alone. Columns other than ``doc_id`` and ``text`` are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers or Tokenizers.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, number = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for start, end in blocks(lengths, block_bytes):
                part = batch.slice(start, end - start)
                found = tables.encode(part.column(1).to_pylist())
                n_a, n_b = (np.array([len(f[side]) for f in found]) for side in (0, 1))
                a, b = (np.concatenate([f[side] for f in found]) for side in (0, 1))
                pairs, held = Block(tables, n_a, n_b, a, b).pairs()
                columns = [
                    pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)), _list([n_a], pa.int32()), _list([n_b], pa.int32()),
                    *[pa.array([_packed(ids, kind)]) for ids, kind in zip((a, b), tables.kinds)], _list([pairs], pa.int64()), _list([held], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, BLOCK_SCHEMA.replace(",", "").split()[::2])
                number += 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, BLOCK_SCHEMA), "alignment-blocks")


def _block(tables: Tokenizers, row: dict) -> Block:
    n_a, n_b = (np.array(row[n], dtype=np.int64) for n in ("n_a", "n_b"))
    ids = (_unpacked(row[side], kind, int(n.sum())) for side, kind, n in zip("ab", tables.kinds, (n_a, n_b)))
    return Block(tables, n_a, n_b, *ids)


def links(written: DataFrame, tokenizers: Tokenizers | None = None) -> DataFrame:
    """``doc_id, a, b, link_a, link_b, cuts``: each document's ids, links as places in them, and cuts as byte offsets.

    Offsets count from the space in front of the text; ``written`` comes from ``tokenize``.
    """
    shared = written.sparkSession.sparkContext.broadcast(tokenizers or Tokenizers.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for row in (row for batch in batches for row in batch.to_pylist()):
            block = _block(tables, row)
            ends = np.cumsum(tables.sizes[0][block.a])
            bounds = [np.concatenate([[0], np.cumsum(x)]) for x in (block.n_a, block.n_b, np.bincount(block.doc, minlength=len(block.n_a)))]
            parts: list[list] = [[] for _ in range(5)]
            for d in range(len(block.n_a)):
                (a0, a1), (b0, b1), (l0, l1) = ((x[d], x[d + 1]) for x in bounds)
                mine, before = slice(l0, l1), ends[a0 - 1] if a0 else 0
                values = (block.a[a0:a1], block.b[b0:b1], block.link_a[mine] - a0, block.link_b[mine] - b0, ends[block.link_a[mine][block.cut[mine]]] - before)
                for part, value in zip(parts, values):
                    part.append(value)
            columns = [pa.array(row["doc_ids"], pa.int64()), *[_list(p, pa.int32()) for p in parts]]
            yield pa.RecordBatch.from_arrays(columns, LINK_SCHEMA.replace(",", "").split()[::2])

    return written.drop("pairs", "held").mapInArrow(run, LINK_SCHEMA)


def pair_counts(written: DataFrame, tokenizers: Tokenizers | None = None) -> DataFrame:
    """``pair, n, best``: documents that link each id pair, and whether no other pair of its A id has more.

    ``pair`` is the id of A times the size of B's vocabulary plus the id of B. One row for each pair
    of ids that occurs; the table of A's highest counts has at most a row for each id of A.
    """
    width = len((tokenizers or Tokenizers.read()).b_bytes)
    pairs = written.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("p.*")
    counts = materialize(pairs.groupBy(F.col("pairs").alias("pair")).agg(F.sum("held").alias("n")), "alignment-counts")
    id_a = F.floor(F.col("pair") / width).alias("id_a")
    highest = counts.groupBy(id_a).agg(F.max("n").alias("highest"))
    return counts.select("pair", "n", id_a).join(F.broadcast(highest), "id_a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def summarise(docs: DataFrame, tokenizers: Tokenizers | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every document.

    ``n_best`` counts links whose pair has its A id's highest count, ``count_sum`` adds up the counts of
    all links, ``groups`` spells the ids between cuts. Odd rows are treated as ``tokenize`` says; documents
    without tokens have zeros and an empty ``groups``.
    """
    tokenizers = tokenizers or Tokenizers.read()
    written = tokenize(docs, tokenizers, block_bytes)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizers)
    wanted = written.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
    counted = wanted.join(pair_counts(written, tokenizers), "pair").select("of", "pair", "n", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, row = shared.value, left.to_pylist()[0]
        block = _block(tables, row)
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs)
        at = order[np.searchsorted(pairs, block.pair, sorter=order)] if len(pairs) else np.empty(0, dtype=np.int64)
        n, best = right.column("n").to_numpy()[at], right.column("best").to_numpy()[at]
        sums = [block.cut, np.ones(len(at)), best, n]
        columns = [block.n_a, block.n_b, *[block.per_document(s) for s in sums]]
        arrays = [pa.array(row["doc_ids"], pa.int64()), *[pa.array(c).cast(pa.int64()) for c in columns], pa.array(block.groups(), pa.string())]
        return pa.Table.from_arrays(arrays, SUMMARY_SCHEMA.replace(",", "").split()[::2])

    tokens = written.drop("pairs", "held")
    return tokens.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(run, SUMMARY_SCHEMA)
