import random

from nearkin.llm import substrings
from llm_helpers import documents, odd_rows, words


def plain(rows):
    """Windows seen in a smaller document or earlier in the same one; rows of one id are alike."""
    seen, result, done = {}, [], {}
    for d, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if (d, t) in done:
            result.append(done[d, t])
            continue
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i : i + 100]
            if seen.setdefault(window, (d, i)) != (d, i):
                gone[i : i + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        done[d, t] = (d, len(data), spans, kept)
        result.append(done[d, t])
    return sorted(result, key=repr)


def found(spark, rows):
    stripped = substrings.remove_repeats(documents(spark, rows, clashes=True)).collect()
    return sorted(((r["doc_id"], r["n_bytes"], len(r["removed"]), bytes(r["kept"])) for r in stripped), key=repr)


def test_repeats_match_brute_force(spark):
    rng = random.Random(4)
    passages = [words(rng, 40) for _ in range(4)]
    rows = [(200, "x" * 450, "s"), (201, "ab" * 230, "s"), (202, "x" * 300, "s"), (203, None, "s"), (204, "y" * 99, "s"), (205, "", "s")]
    for i in range(50):
        text = words(rng, rng.randint(0, 50))
        for _ in range(rng.randint(0, 3)):
            passage, at = rng.choice(passages), rng.randint(0, 40)
            text += " " + passage[at : at + rng.randint(90, 190)] + " " + words(rng, 4)
        rows.append((i, text, "s"))
    rows += [(100, rows[9][1], "s"), (101, rows[9][1], "s")]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [r for r in odd_rows() if r[0] != 1]
    assert found(spark, rows) == plain(rows)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [words(rng, 300) + passage + words(rng, 200) for _ in range(3)]
    monkeypatch.setattr(substrings, "PIECE", 700)
    pieces = [list(substrings.segments([t.encode()])) for t in texts]
    starts = [sorted(s for block in p for a, n in zip(block[1], block[2]) for s in range(a, a + n)) for p in pieces]
    assert starts == [list(range(len(t.encode()) - 99)) for t in texts]


def test_empty(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0
