"""Encoding texts with a merge-type (BPE) SentencePiece model, and decoding ids.

Such a model merges the pair of neighbouring symbols with the best score, leftmost first, until no
pair is a piece. Merges inside two neighbouring pieces never see what lies beyond them, so a sequence
of pieces is the encoding of its text exactly if each neighbouring two, merged from single symbols
on their own, end as these two. The encoder therefore goes from left to right: it takes the longest
piece that starts at a place (found for all places by one Aho-Corasick pass over the reversed text),
asks whether it stays apart from the piece before, tries shorter ones if not, and steps back if none
is left. A place that failed once is marked in a bit field and never entered again: the pieces up to
a place do not depend on what follows, so each place is left at most once.

Texts are cut at places no piece spans (before a space mark that follows something else, and around
symbols of no piece), so that words are encoded once per process.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from math import inf

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import blocks, map_batches

MODEL = "piece_bpe_32k.model"
# The symbol that stands for a space in pieces.
MARK = "▁"
# Words and pairs of pieces a process remembers before it drops the ones not met lately; longer words are not kept.
WORDS, PAIRS, WORD = 150_000, 400_000, 48
# What an unknown id becomes, as the library writes it.
UNKNOWN = " ⁇ "
# Kinds of ids.
NORMAL, BYTE, SILENT, UNKNOWN_ID = range(4)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Pieces:
    """A model's pieces by id with their scores and kinds."""

    pieces: list[str]
    scores: list[float]
    kinds: bytes

    @staticmethod
    def read(path: str | None = None) -> Pieces:
        """A model file: merge type, a space in front of a text, white space kept, unknown symbols as bytes."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or model_path())
        ids = range(model.get_piece_size())
        if model.encode("a  b", out_type=str)[0][0] != MARK or "".join(model.encode("a  b", out_type=str)) != f"{MARK}a{MARK}{MARK}b":
            raise ValueError("the model does not keep white space behind a leading space")
        kinds = [BYTE if model.is_byte(i) else UNKNOWN_ID if model.is_unknown(i) else SILENT if model.is_control(i) else NORMAL for i in ids]
        if kinds.count(BYTE) != 256 or any(model.is_unused(i) for i in ids):
            raise ValueError("the model needs a piece for every byte and no unused ones")
        return Pieces([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], bytes(kinds))

    @cached_property
    def encoder(self) -> Encoder:
        return Encoder(self)

    @cached_property
    def joined(self) -> pa.Array:
        """The same as a column; silent ids, which end a run of bytes, are an invalid byte."""
        return pa.array([raw or b"\xff" for raw in self.raw], pa.binary())

    @cached_property
    def raw(self) -> list[bytes]:
        """What each id adds to a decoded text."""
        table = []
        for piece, kind in zip(self.pieces, self.kinds):
            text = {NORMAL: piece.replace(MARK, " "), SILENT: "", UNKNOWN_ID: UNKNOWN}.get(kind)
            table.append(bytes([int(piece[1:-1], 16)]) if text is None else text.encode())
        return table


class Encoder:
    """Encodes texts; one per process, as it remembers words."""

    def __init__(self, pieces: Pieces):
        normal = [i for i, k in enumerate(pieces.kinds) if k == NORMAL]
        self.ids = {pieces.pieces[i]: i for i in normal}
        # Merges happen from the smallest value on.
        self.order = {pieces.pieces[i]: -pieces.scores[i] for i in normal}
        self.bytes = {int(pieces.pieces[i][1:-1], 16): i for i, k in enumerate(pieces.kinds) if k == BYTE}
        self.automaton = ahocorasick.Automaton()
        # Single symbols need no search.
        for piece in (p for p in self.ids if len(p) > 1):
            self.automaton.add_word(piece[::-1], piece)
        self.automaton.make_automaton()
        # The next shorter piece at the start of each one met, or its first symbol.
        self.shorter: dict[str, str | None] = {}
        symbols = set("".join(self.ids))
        lone = "".join(f"\\x{c:02x}" for c in range(32) if chr(c) not in symbols)
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            self.cut = re.compile("(?s).+")
        else:
            self.cut = re.compile(f"{MARK}*[^{MARK}{lone}]+|{MARK}+|[{lone}]" if lone else f"{MARK}*[^{MARK}]+|{MARK}+")
        # Ids of words as 32-bit numbers: those met lately, and the generation before.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # What follows a piece where another is the longest match: it or the next shorter one that stays apart, or "".
        self.pairs: dict[tuple[str, str], str] = {}

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without begin and end; the empty text has none."""
        return self.numbers(text).tolist()

    def numbers(self, text: str) -> np.ndarray:
        known, other = self.words.get, self._word
        words = self.cut.findall(MARK + text.replace(" ", MARK)) if text else ()
        return np.frombuffer(b"".join([known(word) or other(word) for word in words]), dtype=np.int32)

    def _word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            found = self.split(word)
            try:
                numbers = [self.ids[piece] for piece in found]
            except KeyError:
                unknown = [[self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode()] for p in found]
                numbers = [i for ids in unknown for i in ids]
            ids = array("i", numbers).tobytes()
        if len(word) <= WORD:
            if len(self.words) >= WORDS:
                self.older = self.words.copy()
                self.words.clear()
            self.words[word] = ids
        return ids

    def split(self, word: str) -> list[str]:
        """The pieces of a word; symbols of no piece stand alone."""
        end = len(word)
        # At each place, the longest match comes first, so it is the last one here to be written.
        longest = dict(list(self.automaton.iter(word[::-1]))[::-1])
        failed: bytearray | None = None
        found: list[str] = []
        known = self.pairs.get
        place, last = 0, ""
        piece = longest.get(end - 1) or word[0]
        while place < end:
            while piece:
                fit = known((last, piece))
                piece = self._fitting(last, piece) if fit is None else fit
                to = place + len(piece)
                if not piece or failed is None or not failed[to >> 3] >> (to & 7) & 1:
                    break
                piece = self._shorter(piece)
            if piece:
                found.append(piece)
                place, last = to, piece
                if place < end:
                    piece = longest.get(end - 1 - place) or word[place]
            else:
                if failed is None:
                    failed = bytearray(end // 8 + 1)
                failed[place >> 3] |= 1 << (place & 7)
                piece = found.pop()
                place -= len(piece)
                last = found[-1] if found else ""
        return found

    def _shorter(self, piece: str) -> str | None:
        try:
            return self.shorter[piece]
        except KeyError:
            starts = (piece[:size] for size in range(len(piece) - 1, 0, -1))
            found = next((s for s in starts if s in self.order or len(s) == 1), None)
            if piece in self.order:
                self.shorter[piece] = found
            return found

    def _fitting(self, last: str, piece: str) -> str:
        tried, fit = [], piece
        while fit and not self.stays_apart(last, fit):
            tried.append(fit)
            fit = self._shorter(fit)
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        for one in [piece, *tried]:
            self.pairs[last, one] = fit or ""
        return fit or ""

    def stays_apart(self, left: str, right: str) -> bool:
        """Whether ``left`` and ``right``, merged together from single symbols, end as these two."""
        parts, get = [*left, *right], self.order.get
        border = len(left)
        scores = [get(x + y, inf) for x, y in zip(parts, parts[1:])]
        while scores:
            best = min(scores)
            if best == inf:
                break
            at = scores.index(best)
            if at == border - 1:
                return False
            border -= at < border
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + parts[at], inf)
            if at < len(scores):
                scores[at] = get(parts[at] + parts[at + 1], inf)
        return border == (1 if left else 0) and len(parts) == border + 1


def _replaced(run: bytes) -> str:
    """UTF-8, each byte outside a valid symbol as U+FFFD."""
    found = []
    while run:
        try:
            found.append(run.decode())
            break
        except UnicodeDecodeError as wrong:
            found.append(run[: wrong.start].decode() + "�")
            run = run[wrong.start + 1 :]
    return "".join(found)


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The library's text of ids: without the space put in front, invalid bytes as U+FFFD."""
    raw, kinds = pieces.raw, pieces.kinds
    first = next((i for i in ids if kinds[i] != SILENT), None)
    start = first is not None and kinds[first] == NORMAL and pieces.pieces[first].startswith(MARK)
    text = "".join(_replaced(b"".join([raw[i] for i in run])) for _, run in groupby(ids, key=lambda i: kinds[i]))
    return text[1:] if start else text


def decode_lists(pieces: Pieces, ids: pa.ListArray) -> list[str]:
    """The same for a column: joined at once, row by row only where bytes are not valid UTF-8."""
    ids = ids.fill_null([])
    parts = pieces.joined.take(ids.flatten())
    sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).astype(np.int32)
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(sizes), parts), b"").to_pylist()
    heads, texts = ids.flatten().take(pa.array(np.minimum(sizes[:-1], max(len(parts) - 1, 0)))).to_pylist() if len(parts) else [], []
    for row, data in enumerate(joined):
        try:
            text = data.decode()
        except UnicodeDecodeError:
            texts.append(decode_ids(pieces, ids[row].as_py()))
            continue
        head = heads[row] if data else None
        spaced = head is not None and pieces.kinds[head] == NORMAL and data.startswith(b" ")
        texts.append(text[1:] if spaced else text)
    return texts


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, one row per row of ``docs``.

    A null text counts as empty and has no ids, as the empty one; texts of white space have some. Null
    and repeated ids and repeated rows stay as they are; an empty table gives an empty one. Columns other
    than ``doc_id`` and ``text`` are ignored. A long text takes memory in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces or Pieces.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder, sizes = shared.value.encoder, batch.column(1).cast(pa.binary())
        for a, b in blocks([len(x.as_buffer() or b"") if x.is_valid else 0 for x in sizes]):
            part = batch.slice(a, b - a)
            found = [encoder.numbers(t) for t in _texts(part.column(1))]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """``doc_id, ids, text`` of rows with ``doc_id, ids``: what the library's decoder makes of the ids.

    Null ids count as none and give the empty text. An id outside the vocabulary is an error.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(pieces or Pieces.read())

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for a, b in blocks([4 * len(x) if x.is_valid else 0 for x in batch.column(1)]):
            part = batch.slice(a, b - a)
            texts = decode_lists(table, part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return map_batches(rows, run, "doc_id bigint, ids array<int>, text string")
