import random

import numpy as np

from nearkin.llm import packing
from llm_helpers import documents, odd_rows, words


def plain_best_fit(sizes, length):
    room = []
    for size in sorted(sizes, reverse=True):
        fits = [r for r in room if r >= size]
        least = min(fits) if fits else length
        if fits:
            room.remove(least)
        room.append(least - size)
    return sorted(room)


def test_best_fit_matches_a_linear_search():
    rng = random.Random(3)
    for _ in range(200):
        length = rng.randint(1, 60)
        sizes = [rng.randint(0, length) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit(sizes, length)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(length - sum(sizes[i] for i in r) for r in rows) == plain_best_fit(sizes, length)


def check_rows(rows, length):
    for r in rows:
        ids = np.frombuffer(r["token_ids"], "<u2")
        places = np.frombuffer(r["position_ids"], "<u4")
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == length and ends[0] == 0 and ends[-1] == r["n_tokens"] <= length
        assert len(ends) == len(r["doc_ids"]) + 1 == len(r["pieces"]) + 1
        assert all((places[a:b] == np.arange(b - a)).all() for a, b in zip(ends, ends[1:]))
        assert (ids[r["n_tokens"] :] == packing.SEPARATOR).all()


def test_round_trip_and_rows(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, rng.randint(0, 700)) + rng.choice(["", "\n\n", "  x", " ✓ <|endoftext|>"]), "s") for i in range(150)]
    rows += [(500, "a" * 100_000, "s"), (501, " " * 70_000 + "b", "s"), (502, "", "s"), (503, None, "s")]
    docs = documents(spark, rows, clashes=True)
    for length, window in ((2048, 4_000_000), (64, 3_000)):
        packed = packing.pack(docs, length=length, window=window)
        kept = packed.collect()
        check_rows(kept, length)
        assert len({(r["shard"], r["row"]) for r in kept}) == len(kept)
        back = {r["doc_id"]: r["text"] for r in packing.unpack(packed).collect()}
        assert back == {d: t or "" for d, t, _ in rows}


def test_rows_are_well_filled(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(10, 300)), "s") for i in range(400)]
    kept = packing.pack(documents(spark, rows).coalesce(1), length=512).collect()
    assert sum(r["n_tokens"] for r in kept) > 0.97 * 512 * (len(kept) - 1)


def test_odd_rows(spark):
    kept = packing.pack(documents(spark, odd_rows(), clashes=True)).collect()
    check_rows(kept, packing.LENGTH)
    starts = [d for r in kept for d, p in zip(r["doc_ids"], r["pieces"]) if p == 0]
    assert sorted(starts, key=str) == sorted((d for d, _, _ in odd_rows()), key=str)
    assert packing.pack(documents(spark, [])).count() == 0


def test_long_texts_are_encoded_whole():
    encoding = packing.Vocabulary.read().encoding()
    rng = random.Random(6)
    long = words(rng, 60_000)
    assert len(long) > 300_000
    for text in (long, "ab" * 150_000, "a" + " " * 200_000 + "b", " " * 150_000, "x\n" + "\n " * 90_000 + "'s y"):
        assert packing._encode(encoding, text)[:-1].tolist() == encoding.encode_ordinary(text)


def test_white_space_too_long_for_the_pattern():
    encoding = packing.Vocabulary.read().encoding()
    for tail in ("", "b", "\u00a0b"):
        text = "a" + " " * 1_500_000 + tail
        assert encoding.decode(packing._encode(encoding, text)[:-1].tolist()) == text
