"""Distances, encodings, q-grams and lookups on documented examples and against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearkin.functions import distance as d
from nearkin.functions import encode as e
from nearkin.operators import lookup, qgram
from nearkin.plans.join import SimilarityJoin

# Documented examples of both distances.
HAMMING = [("", "", 0), ("pappa", "pappa", 0), ("1011101", "1011111", 1), ("ATCG", "ACCC", 2), ("karolin", "kerstin", 3)]
LEVENSHTEIN = [
    ("", "", 0), ("", "a", 1), ("aaapppp", "", 7), ("frog", "fog", 1), ("fly", "ant", 3), ("elephant", "hippo", 7),
    ("hippo", "elephant", 7), ("hippo", "zzzzzzzz", 8), ("hello", "hallo", 1),
]
BOUNDED = [
    ("", "", 0, 0), ("aaapppp", "", 8, 7), ("aaapppp", "", 7, 7), ("aaapppp", "", 6, -1), ("elephant", "hippo", 7, 7),
    ("elephant", "hippo", 6, -1), ("hippo", "elephant", 7, 7), ("hippo", "elephant", 6, -1),
]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_documented_distances(spark):
    found = values(spark, HAMMING, "x string, y string, want int", d.hamming("x", "y"), "want")
    assert all(a == b for a, b in found)
    found = values(spark, LEVENSHTEIN, "x string, y string, want int", d.levenshtein("x", "y"), "want")
    assert all(a == b for a, b in found)
    for x, y, k, want in BOUNDED:
        assert values(spark, [(x, y)], "x string, y string", d.levenshtein_bounded("x", "y", k)) == [(want,)]


@pytest.mark.parametrize("x, y", [("ab", "abc"), (None, "a"), ("a", None)])
def test_illegal_input_raises(spark, x, y):
    df = spark.createDataFrame([(x, y)], "x string, y string")
    with pytest.raises(Exception, match="same length"):
        df.select(d.hamming("x", "y")).collect()
    if x is None or y is None:
        for f in (d.levenshtein("x", "y"), d.levenshtein_bounded("x", "y", 3)):
            with pytest.raises(Exception, match="null"):
                df.select(f).collect()


def test_negative_threshold_raises():
    for f in (d.hamming_bounded, d.levenshtein_bounded):
        with pytest.raises(ValueError):
            f("x", "y", -1)


@pytest.mark.parametrize("packing, alphabet", [("dna", "ACGTN-"), ("ascii", "aZ09 ~%\t"), ("unicode", "aé漢😀")])
def test_packed_hamming(spark, packing, alphabet):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 1, 7, 8, 9, 20, 21, 22, 43, 255, 256, 600])))
    rows = []
    for _ in range(60):
        x, y = word(), word()
        y = x[: len(y)] + y[len(x) :] if rng.random() < 0.5 else y
        rows.append((x, y, sum(a != b for a, b in zip(x, y)) + abs(len(x) - len(y))))
    packed = [e.packed_words(c, packing) for c in "xy"]
    bounded = [d.packed_hamming_bounded(*packed, k, packing) for k in (0, 3, 50)]
    found = values(spark, rows, "x string, y string, want int", d.padded_hamming("x", "y", packing), "want", *bounded)
    for a, b, *within in found:
        assert a == b
        assert within == [b if b <= k else -1 for k in (0, 3, 50)]
    plan = spark.range(1).select(d.packed_hamming_bounded(F.array(F.col("id")), F.array(F.lit(1)), 3, packing))
    assert plan.first()[0] >= 0


def test_lmers_and_chunks(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ACGTé") for _ in range(n)) for n in (0, 1, 3, 4, 5, 255, 256, 257, 260, 1000)]
    rows = values(spark, [(t,) for t in texts], "s string", "s", e.lmers("s", 4), e.lmer_set("s", 4), e.equal_chunks("s", 4))
    for s, every, distinct, chunks in rows:
        want = [s[i : i + 4] for i in range(len(s) - 3)]
        assert every == want
        assert sorted(distinct) == sorted(set(want))
        assert chunks == [s[i : i + 4] for i in range(0, len(s) // 4 * 4, 4)]


def test_chunks_at(spark):
    found = values(spark, [("ABCDEFGH",)], "s string", e.chunks_at("s", F.array(F.lit(2), F.lit(2), F.lit(5), F.lit(7))))
    assert found == [(["AB", "", "CDE", "FG"],)]


def test_codes_and_letters(spark):
    def code(text, alphabet="ACGT"):
        value = 0
        for c in text:
            value = value * len(alphabet) + alphabet.find(c)
        return (value + 2**63) % 2**64 - 2**63

    texts = ["", "A", "ACGT", "C%", "AT", "T" * 31, "T" * 32, "GATTACA" * 6, "ACNNT", "N"]
    rows = values(spark, [(t,) for t in texts], "s string", "s", e.lmer_code("s"), e.lmer_code("s", "ACGTN"))
    for s, plain, with_n in rows:
        assert (plain, with_n) == (code(s), code(s, "ACGTN"))
    digits = values(spark, [(c,) for c in "ACGTacN%"], "s string", e.letter_to_digit("s"))
    assert [x for (x,) in digits] == [0, 1, 2, 3, -1, -1, -1, -1]
    letters = values(spark, [(i,) for i in range(-1, 7)], "n int", e.digit_to_letter("n"))
    assert "".join(x for (x,) in letters) == "_ACGT-__"
    assert values(spark, [("AC",), ("ACGTA",)], "s string", e.pad_right("s", 4)) == [("AC%%",), ("ACGTA",)]


def test_qgrams(spark):
    texts = {1: "a  b\t\nc a b", 2: "a b c", 3: "xy", 4: "aaaaaa", 5: "aaaa"}
    profiles = qgram.qgram_profile(spark.createDataFrame(list(texts.items()), "id int, text string"), "id", "text")
    grams = {i: Counter(s[p : p + 3] for p in range(len(s) - 2)) for i, s in ((i, " ".join(t.split())) for i, t in texts.items())}
    assert {(r.id, r.gram): r.cnt for r in profiles.collect()} == {(i, g): c for i, p in grams.items() for g, c in p.items()}
    pairs = spark.createDataFrame([(1, 2), (1, 3), (4, 5), (5, 4), (2, 2)], "x int, y int")
    found = {(r.x, r.y): r.similarity for r in qgram.qgram_similarity(pairs, "x", "y", profiles, "id").collect()}
    assert found == {(x, y): (grams[x] & grams[y]).total() for x, y in found}
    assert len(found) == 5


def test_floor_lookup(spark):
    arrays = [([1, 3, 5], x) for x in range(7)]
    found = values(spark, arrays, "a array<int>, x int", lookup.floor_index("a", "x"))
    assert [x for (x,) in found] == [0, 0, 0, 1, 1, 2, 2]
    rows = spark.createDataFrame([(k, v) for k in (0, 4, 9) for v in (1, 3, 3, 5)], "k int, v int")
    assert {r.floor_index for r in lookup.floor_index_by(rows, "k", "v", F.lit(4)).collect()} == {1}


def test_floor_of_long_arrays(spark):
    rng = random.Random(3)
    rows = [(sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 40))), rng.randint(-5, 55)) for _ in range(300)] + [([1, 2], None), (None, 3)]
    found = values(spark, rows, "a array<int>, x int", lookup.floor_index("a", "x"))
    assert [r[0] for r in found] == [max(sum(v <= x for v in a) - 1, 0) if a and x is not None else 0 for a, x in rows]


def test_floor_join(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, *range(60)]), "r") for i in range(800)] + [(5, "hot", 7, "r")] * 200
    right = [(rng.choice(["hot", "a", "c", None]), rng.choice([None, *range(10, 50)])) for _ in range(60)] + [("hot", 11)] * 50
    at = lambda rows, schema: spark.createDataFrame(rows, schema)
    schema = "part int, k string, x int, row string"
    found = lookup.floor_join(at(left, schema), at(right, "k string, at int"), ["k"], "x", "at")
    assert found.columns == ["part", "k", "x", "row", "floor"]
    best = lambda k, x: max((v for j, v in right if j == k and None not in (k, v, x) and v <= x), default=None)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(repr((*r, best(r[1], r[2]))) for r in left)
    none = lookup.floor_join(at(left[:9], schema), at([], "k string, at int"), ["k"], "x", "at")
    assert [r.floor for r in none.collect()] == [None] * 9
    assert lookup.floor_join(at([], schema), at(right, "k string, at int"), ["k"], "x", "at").count() == 0


@pytest.mark.parametrize("l", [1, 2, 3, 7, 11, 30, 31, 40])
def test_codes_of_every_length(spark, l):
    rng = random.Random(l)
    texts = ["", "A", "N" * 45, None] + ["".join(rng.choice("ACGTN") for _ in range(n)) for n in (l - 1, l, l + 1, 64, 300, 600)]
    rows = values(spark, [(t,) for t in texts], "s string", e.lmer_codes("s", l), F.transform(e.lmers("s", l), lambda s: e.lmer_code(s)))
    assert all(r[0] == r[1] for r in rows)


def test_pieces_are_found_where_edits_move_them(spark):
    """Own pieces and those looked for, against their definition; before, each was cut out of the whole text on its own."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("aé日\n") for _ in range(rng.choice([0, 1, 2, 9, 10, 17, 40]))) for _ in range(40)] + ["a" * 30]
    for k, limit, shifts in ((0, 0, True), (2, 2, True), (3, 12, True), (4, 4, False)):
        cut = lambda n, m: (m * (n // (k + 1)) + max(m - (k + 1 - n % (k + 1)), 0), n // (k + 1) + (m >= k + 1 - n % (k + 1)))
        own = {}
        for i, x in enumerate(texts):
            for m in range(k + 1):
                at, size = cut(len(x), m)
                own[i, m] = (len(x), m, x[at : at + size])
        looked = [set() for _ in texts]
        for i, x in enumerate(texts):
            for n in range(max(len(x), limit + 1), len(x) + k + 1):
                for m in range(k + 1):
                    at, size = cut(n, m)
                    gap = len(x) - n
                    for p in range(max(at - m, at + gap - (k - m)), min(at + m, at + gap + (k - m)) + 1) if shifts else [at]:
                        if p >= 0 and p + size <= len(x):
                            looked[i].add((n, m, x[p : p + size]))
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").repartition(2)
        found = rows.select("i", e.piece_keys("s", k).alias("own"), e.piece_probes("s", k, limit, shifts).alias("looked")).collect()
        keys = {r["i"]: r["own"] for r in found}
        name = {piece: keys[i][m] for (i, m), piece in own.items()}
        assert all(len(v) == k + 1 for v in keys.values()) and len(set(name.values())) == len(name)
        for r in found:
            assert len(r["looked"]) == len(looked[r["i"]])
            assert {p for p in name if p in looked[r["i"]]} == {p for p, key in name.items() if key in set(r["looked"])}


def test_only_joins_that_compare_words_pack_them(spark):
    rows = spark.createDataFrame([(1, "ünlike dna"), (2, "ünlikedna")], "seq_id long, seq string")
    for metric, packs in (("edit", False), ("hamming", True)):
        join = SimilarityJoin(rows, 3, metric, l=2)
        assert ("words" in join.units.columns) == packs
        assert join.metrics().first()["related_pairs"] == (metric == "edit")
