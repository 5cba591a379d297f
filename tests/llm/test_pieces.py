"""SentencePiece encoding and decoding against the library itself."""

import random

import pyarrow as pa
import pytest
import sentencepiece

from llm_helpers import SCHEMA, documents, odd_rows
from nearkin.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())


PARTS = [" ", "  ", "▁", "▁▁", "a", "e", "t", "th", "ing", "\n", "\t", "\x00", "x", "é", "日", "本", "😀", "ก", "в", "<s>", "<0x41>", "1", "20", "'", "."]


def test_random_texts(model, library):
    rng = random.Random(5)
    normal = [p for p, k in zip(model.pieces, model.kinds) if k == pieces.NORMAL]
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += ["".join(rng.choice(normal) for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    texts += ["", " ", "x" * 20_000, "ab" * 9_000, " " * 9_999, "日本" * 9_000, "\x00" * 300]
    found = [model.encoder.encode(t) for t in texts]
    assert found == library.encode(texts, num_threads=1)
    assert [pieces.decode_ids(model, ids) for ids in found] == [library.decode(ids) for ids in found]


def test_without_cuts(model, library):
    encoder = pieces.Encoder(model)
    encoder.cut = pieces.re.compile("(?s).+")
    rng = random.Random(8)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    assert [encoder.encode(t) for t in texts] == library.encode(texts, num_threads=1)


def test_memory_is_started_again(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 7)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    encoder, rng = pieces.Encoder(model), random.Random(9)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(20)) for _ in range(50)]
    assert [encoder.encode(t) for t in texts] == library.encode(texts, num_threads=1)
    assert len(encoder.words) <= 7 and len(encoder.older) <= 7 and len(encoder.pairs) <= 5


def test_random_ids(model, library):
    rng = random.Random(6)
    kinds = [lambda: rng.randrange(3, 259), lambda: rng.randrange(len(model.pieces)), lambda: rng.choice([0, 1, 2, 259])]
    for _ in range(8000):
        ids = [rng.choice(kinds)() for _ in range(rng.randint(0, 9))]
        assert pieces.decode_ids(model, ids) == library.decode(ids)


def test_columns_of_random_ids(model, library):
    rng = random.Random(7)
    kinds = [lambda: rng.randrange(3, 259), lambda: rng.randrange(len(model.pieces)), lambda: rng.randrange(259, len(model.pieces)), lambda: rng.choice([0, 1, 2, 259])]
    lists = [[rng.choice(kinds[: rng.randint(1, 4)] if rng.random() < 0.5 else kinds[2:3])() for _ in range(rng.randint(0, 9))] for _ in range(6000)]
    lists[:3] = [[], None, []]
    column = pa.array(lists, pa.list_(pa.int32()))
    wanted = [library.decode(x or []) for x in lists]
    assert pieces.decode_lists(model, column) == wanted
    assert pieces.decode_lists(model, column.slice(5, 90)) == wanted[5:95]
    assert pieces.decode_lists(model, column.slice(0, 3)) == ["", "", ""]


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(spark, library, clashes):
    rows = odd_rows()
    found = pieces.decode(pieces.encode(documents(spark, rows, clashes)))
    assert found.columns == ["doc_id", "ids", "text"]
    wanted = [(d, library.encode(t or ""), library.decode(library.encode(t or ""))) for d, t, _ in rows]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_empty_and_null(spark):
    assert pieces.decode(pieces.encode(spark.createDataFrame([], SCHEMA))).collect() == []
    assert [tuple(r) for r in pieces.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).collect()] == [(1, None, "")]
