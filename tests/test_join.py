"""The joins against published and brute-force results."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from nearkin.functions.distance import bounded_levenshtein, edits_within
from nearkin.functions.encode import packing_of  # noqa: F401
from nearkin.plans import candidates
from nearkin.plans.candidates import longest_for_deletions
from nearkin.plans.join import SimilarityJoin
from nearkin.sources.fasta import read_fasta

# Folder of published sample files, where there is one.
DATA = os.environ.get("NEARKIN_SAMPLES", "")


def levenshtein(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        previous, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (a != b))
    return row[-1]


def padded(x, y):
    return sum(a != b for a, b in zip(x, y)) + abs(len(x) - len(y))


def brute(rows, k, metric, scope):
    measure = levenshtein if metric == "edit" else padded
    allowed = {"all": lambda s, t: True, "within": lambda s, t: s == t, "across": lambda s, t: s != t}[scope]
    out = set()
    for at, (s, i, x) in enumerate(rows):
        for t, j, y in rows[at + 1 :]:
            if allowed(s, t) and abs(len(x) - len(y)) <= k and measure(x, y) <= k:
                (s1, i1), (s2, j1) = sorted([(s, i), (t, j)])
                out.add({"all": (i1, j1), "within": (s1, i1, j1), "across": (s1, s2, i1, j1)}[scope])
    return out


def family_strings(seed, n, lengths, alphabet="ACGT"):
    """Random strings with near copies and exact copies, in two samples."""
    rng = random.Random(seed)
    rows, ids = [], {"s": 0, "t": 0}
    base = ""
    for at in range(n):
        if at % 6 == 0:
            base = "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths)))
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            p = rng.randint(0, len(text))
            kind = rng.random()
            if kind < 0.4 and p < len(text):
                text[p] = rng.choice(alphabet)
            elif kind < 0.7 and p < len(text):
                del text[p]
            else:
                text.insert(p, rng.choice(alphabet))
        name = rng.choice("st")
        rows.append((name, ids[name], "".join(text)))
        ids[name] += 1
    return rows


CASES = [
    (1, [30, 40], [dict(k=2, metric="edit", l=6), dict(k=2, metric="hamming", l=6), dict(k=2, metric="hamming", chunks=7)]),
    (2, [3, 8, 14, 40], [dict(k=3, metric="edit", l=5), dict(k=3, metric="hamming", l=5), dict(k=3, metric="hamming", chunks=3)]),
    (3, [2, 5, 12, 30], [dict(k=4, metric="edit"), dict(k=4, metric="hamming"), dict(k=10, metric="edit", l=3)]),
    (5, [40, 41], [dict(k=2, metric="edit", l=10, frequent=2), dict(k=2, metric="hamming", l=10, frequent=2)]),
    (4, [12], [dict(k=1, metric="edit", l=2, frequent=3), dict(k=1, metric="hamming", l=2, frequent=3)]),
]


@pytest.mark.parametrize("seed, lengths, options", CASES)
def test_equals_brute_force(spark, seed, lengths, options):
    rows = family_strings(seed, 70, lengths, "ACGT" if seed != 3 else "abé")
    one = [("", i, x) for i, (_, _, x) in enumerate(rows)]
    single = spark.createDataFrame(one, "sample string, seq_id int, seq string").drop("sample").cache()
    for opt in options:
        join = SimilarityJoin(single, **opt)
        edges = [tuple(r) for r in join.edges().collect()]
        assert len(edges) == len(set(edges)), opt
        assert set(edges) == brute(one, opt["k"], opt["metric"], "all"), opt
        assert join.metrics().first().related_pairs == len(edges)


@pytest.mark.parametrize("scope", ["within", "across"])
def test_samples_equal_brute_force(spark, scope):
    rows = family_strings(7, 60, [20, 28])
    df = spark.createDataFrame(rows, "sample string, seq_id int, seq string").cache()
    for opt in (dict(k=2, metric="edit", l=5), dict(k=2, metric="hamming", l=5), dict(k=2, metric="hamming")):
        join = SimilarityJoin(df, scope=scope, sample="sample", **opt)
        edges = [tuple(r) for r in join.edges().collect()]
        assert len(edges) == len(set(edges))
        assert set(edges) == brute(rows, opt["k"], opt["metric"], scope), opt


def test_copies_are_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("nearkin.plans.join.COPY_BLOCK", 4)
    rows = [("", i, "ACGTACGTAC" if i % 3 else "ACGTACGTAA") for i in range(40)]
    df = spark.createDataFrame(rows, "sample string, seq_id int, seq string").drop("sample")
    join = SimilarityJoin(df, 1, l=2)
    assert sorted(map(tuple, join.edges().collect())) == [(i, j) for i in range(40) for j in range(i + 1, 40)]
    (pair,) = join.pairs().collect()
    assert tuple(pair) == (0, 1, 14, 26)
    assert join.metrics().first().related_pairs == 40 * 39 // 2


def test_strict_mode_and_validation(spark):
    df = spark.createDataFrame([(0, "ACGTACGT"), (1, "ACGTACGA")], "seq_id int, seq string")
    assert SimilarityJoin(df, 1, "hamming", chunks=2).edges().count() == 1
    assert SimilarityJoin(df, 1, "hamming", chunks=2, strict=True).edges().count() == 0
    assert SimilarityJoin(df, 1, "hamming", chunks=3, strict=True).edges().count() == 1
    for bad in (dict(k=-1), dict(k=1, l=0), dict(k=1, chunks=4), dict(k=1, scope="across"), dict(k=1, metric="other")):
        with pytest.raises(ValueError):
            SimilarityJoin(df, **bad)
    with pytest.raises(ValueError, match="null"):
        SimilarityJoin(spark.createDataFrame([(0, None)], "seq_id int, seq string"), 1).pairs()
    assert longest_for_deletions(1) == 255


# Published and modelled results for the sample files, k=10.
GOLDEN = [
    ("query1/close.fas", dict(metric="edit", l=11), (837, 784, 784), "0ef17cde0bf5f6678c949a191e592005"),
    ("query2/medium.fas", dict(metric="edit", l=11), (4429, 3196, 3196), "58ce8aa182593b9bc4566ace6cfc42a4"),
    ("query3/far.fas", dict(metric="edit", l=11), (86, 59, 59), "467dcfaf129af27262744c591309ae19"),
    ("db1/1000.fas", dict(metric="edit", l=11), (65937, 60420, 60421), "e5b8453a9412a6d04938d04056f57d7e"),
    ("db1/1000.fas", dict(metric="hamming", chunks=17), (64573, 60420, 60420), "4af51c6315011e90b71546d388112a2f"),
]


@pytest.mark.parametrize("file, options, figures, digest", GOLDEN if DATA else [])
def test_golden_runs(spark, file, options, figures, digest):
    reads = read_fasta(spark, f"{DATA}/{file}").cache()
    join = SimilarityJoin(reads, 10, **options)
    found = join.metrics().first()
    assert (found.comparisons, found.passed_hamming, found.related_pairs) == figures
    edges = sorted((r.i, r.j) for r in join.edges().collect())
    text = "".join(f"{i} {j}\n" for i, j in edges)
    assert hashlib.md5(text.encode()).hexdigest() == digest


if DATA:

    def test_golden_entropy_chunks(spark):
        reads = read_fasta(spark, f"{DATA}/db1/1000.fas")
        ends = SimilarityJoin(reads, 10, "hamming", chunks=17).chunk_ends
        assert ends == [24, 56, 88, 120, 152, 169, 176, 183, 192, 200, 206, 212, 218, 226, 233, 243, 263]
        assert SimilarityJoin(reads, 10, "hamming", chunks=12).chunk_ends == [31, 63, 95, 127, 159, 177, 192, 203, 214, 226, 241, 263]


def conserved_set(strings=300, length=264, seed=17):
    """Families of reads of the published runs' shape: conserved stretches, variable ones, a few indels."""
    rng = random.Random(seed)
    base = [rng.choice("ACGT") for _ in range(length)]
    reads = []
    for family in range(6):
        root = list(base)
        for p in range(160, length):
            if rng.random() < 0.25:
                root[p] = rng.choice("ACGT")
        for _ in range(strings // 6):
            read = list(root)
            for _ in range(rng.choice([0, 1, 3, 6, 9])):
                read[rng.randrange(150, length)] = rng.choice("ACGT")
            reads.append("".join(read))
    return reads


def test_published_shape_against_a_plain_model(spark):
    k, strings = 10, conserved_set()
    df = spark.createDataFrame(list(enumerate(strings)), "seq_id int, seq string")
    join = SimilarityJoin(df, k, "hamming", chunks=17)
    cut = [[s[a:b] for a, b in zip([0, *join.chunk_ends], join.chunk_ends)] for s in strings]
    comparisons, edges = 0, set()
    for j in range(len(strings)):
        for i in range(j):
            shared = sum(x == y for x, y in zip(cut[i], cut[j]))
            near = padded(strings[i], strings[j]) <= k
            comparisons += near or shared >= 17 - k
            if near:
                edges.add((i, j))
    found = join.metrics().first()
    assert len(join.chunk_ends) == 17 and (found.comparisons, found.related_pairs) == (comparisons, len(edges))
    assert {(r.i, r.j) for r in join.edges().collect()} == edges
    assert SimilarityJoin(df, k, "edit", l=11).metrics().first().passed_hamming == len(edges)


def test_comparisons_do_not_depend_on_frequency(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, "ACGTACGTACG" * 3 + "".join(rng.choice("acgt") for _ in range(11))) for i in range(120)]
    df = spark.createDataFrame(rows, "seq_id int, seq string")
    wanted = 120 * 119 // 2
    assert SimilarityJoin(df, 1, l=11, frequent=5).metrics().first().comparisons == wanted
    monkeypatch.setattr("nearkin.plans.candidates.KEY_BLOCK", 7)
    for options in (dict(l=11), dict(metric="hamming", l=11), dict(l=11, frequent=5)):
        join = SimilarityJoin(df, 1, **options)
        assert join.metrics().first().comparisons == wanted
        assert join.compared().where("enough").count() == wanted
    near = [(i, s[:20] + "".join(rng.choice("AC") for _ in range(2)) + s[22:]) for i, (_, s) in enumerate(rows)]
    df = spark.createDataFrame(near, "seq_id int, seq string")
    for metric in ("edit", "hamming"):
        found = {tuple(r) for r in SimilarityJoin(df, 3, metric).edges().collect()}
        distance = levenshtein if metric == "edit" else padded
        assert found == {(i, j) for j, (_, y) in enumerate(near) for i, (_, x) in enumerate(near[:j]) if distance(x, y) <= 3}


def test_a_hot_key_is_dealt_into_cells(spark):
    """100 000 units of one key: cells stay below the bound and every pair meets in exactly one of them."""
    side = lambda n: spark.range(n).select(F.col("id").alias("u"), F.when(F.col("id") % 50 == 49, F.col("id")).otherwise(-1).alias("key"))
    x, y = side(100_000), side(30_000)
    hot = candidates.hot_keys(x, y)
    assert [tuple(r) for r in hot.collect()] == [(-1, 11, 4)]
    in_x, in_y = candidates.in_cells(x, y, hot)
    sizes = lambda t, name: t.groupBy("key", "cell").agg(F.count(F.lit(1)).alias(name))
    cells = sizes(in_x, "nx").join(sizes(in_y, "ny"), ["key", "cell"]).where("key = -1").collect()
    assert len(cells) == 44 and all(max(c.nx, c.ny) <= candidates.KEY_BLOCK for c in cells)
    some = lambda t, step: t.where(F.col("u") % step == 0)
    met = some(in_x, 501).alias("x").join(some(in_y, 97).alias("y"), ["key", "cell"]).select("x.u", "y.u")
    assert met.count() == met.distinct().count() == some(x, 501).alias("x").join(some(y, 97).alias("y"), "key").count()


def test_exploded_keys_are_not_broadcast(spark):
    df = spark.createDataFrame([(i, f"ACGTAC{i:06d}") for i in range(60)], "seq_id int, seq string")
    for options in (dict(k=1), dict(k=2), dict(k=1, metric="hamming"), dict(k=1, l=3)):
        plan = SimilarityJoin(df, **options).candidates()._jdf.queryExecution().executedPlan().toString()
        broadcast = [part for part in plan.split("BroadcastExchange")[1:] if "Generate" in part.split("Join")[0]]
        assert not broadcast


def test_the_nul_character_is_a_symbol(spark):
    x, y = "ACGTACGTACGTxyzwvklmn", "ACGTACGTACGTxyzwvkQQn\0"
    df = spark.createDataFrame([(0, x), (1, y)], "seq_id int, seq string")
    for metric in ("edit", "hamming"):
        assert SimilarityJoin(df, 2, metric, l=4).edges().count() == 0
        assert SimilarityJoin(df, 3, metric, l=4).edges().count() == 1


def test_bounded_distances_of_many_pairs(spark):
    rng = random.Random(5)
    for k in range(7):
        xs, ys = (["".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(600)] for _ in range(2))
        wanted = [d if d <= k else -1 for d in map(levenshtein, xs, ys)]
        assert edits_within(xs, ys, k).tolist() == wanted
    assert edits_within([], [], 3).tolist() == []
    assert edits_within(["", "é😀", "\0", "abc"], ["", "é✓", "", "abcdefgh"], 2).tolist() == [0, 1, 1, -1]
    for symbols in ("ACGT", "aé✓😀"):
        rows = [(x, "".join(c if rng.random() < 0.95 else rng.choice(symbols) for c in x)) for x in ("".join(rng.choice(symbols) for _ in range(rng.randint(50, 300))) for _ in range(300))]
        rows += [(None, "a"), ("a", None)]
        pairs = spark.createDataFrame(rows, "x string, y string")
        found = pairs.select(bounded_levenshtein("x", "y", 9).alias("mine"), F.levenshtein("x", "y", 9).alias("theirs")).collect()
        assert [r.mine for r in found] == [r.theirs for r in found] and {-1, None} < {r.mine for r in found}


def test_bounded_distance_of_long_strings():
    rng = random.Random(6)
    long = "".join(rng.choice("abcd") for _ in range(32_000))
    edited = long[:9000] + "z" + long[9001:20000] + long[20003:] + "qq"
    assert edits_within([long, long, "a" * 50_000], [edited, long[::-1], "a" * 49_994], 8).tolist() == [6, -1, 6]
    start = time.perf_counter()
    for _ in range(20):
        edits_within([long], [edited], 8)
    assert (time.perf_counter() - start) / 20 < 0.05


def test_short_strings_are_judged_where_they_meet(spark):
    """Names that share their start: one join of keys decides, each pair once, and no text is attached to pairs."""
    rng = random.Random(9)
    rows = [(rng.choice("st"), i, f"Name#000{rng.randrange(2000):04d}z") for i in range(250)]
    uneven = [(s, i, t.replace("7", "") if i % 3 else t) for s, i, t in rows]
    for options, data in ((dict(k=1, metric="edit"), uneven), (dict(k=2, metric="edit"), uneven), (dict(k=2, metric="hamming"), rows), (dict(k=0, metric="hamming"), rows)):
        df = spark.createDataFrame(data, "sample string, seq_id int, seq string")
        for scope in ("all", "within", "across"):
            join = SimilarityJoin(df, scope=scope, sample=None if scope == "all" else "sample", **options)
            plan = join.pairs()._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") == 1 and "Python" not in plan and "ArrowEval" not in plan
            edges = [tuple(r) for r in join.edges().collect()]
            named = data if scope != "all" else [("", i, t) for _, i, t in data]
            assert len(edges) == len(set(edges)) and set(edges) == brute(named, options["k"], options["metric"], scope), (options, scope)


def test_reads_are_joined_by_pieces(spark, monkeypatch):
    """A few pieces a string, not all its l-mers, where pieces are rare; signatures where a part is in all strings."""
    rows = [("", i, t) for i, (_, _, t) in enumerate(family_strings(12, 60, [64]))]
    df = spark.createDataFrame(rows, "sample string, seq_id int, seq string").drop("sample")
    wanted = brute(rows, 3, "edit", "all")
    monkeypatch.setattr(candidates, "_places", None)
    assert {tuple(r) for r in SimilarityJoin(df, 3, "edit", l=12).edges().collect()} == wanted
    monkeypatch.undo()
    monkeypatch.setattr(candidates, "FEW_PAIRS", 0)
    assert {tuple(r) for r in SimilarityJoin(df, 3, "edit", l=12).edges().collect()} == wanted


def test_an_edit_turns_four_bits_of_a_sketch_at_most():
    from nearkin.functions.encode import sketches

    rng = random.Random(5)
    for k in (1, 3, 8):
        texts = ["".join(rng.choice("abcdé☃") for _ in range(rng.choice([0, 1, 2, 30, 400]))) for _ in range(200)]
        others = []
        for t in texts:
            for _ in range(k):
                p = rng.randint(0, len(t))
                t = rng.choice([t[:p] + "x" + t[p:], t[:p] + t[p + 1 :], t[:p] + "é" + t[p + 1 :]])
            others.append(t)
        turned = [sum(int(w).bit_count() for w in row.view("<u8")) for row in sketches(texts) ^ sketches(others)]
        assert max(turned) <= 4 * k
    far = sketches(["".join(chr(rng.randrange(97, 160)) for _ in range(500)) for _ in range(2)])
    assert sum(int(w).bit_count() for w in (far[0] ^ far[1]).view("<u8")) > 64


def test_short_strings_are_judged_where_pieces_meet(spark, monkeypatch):
    """Pairs of one host leave the join once and only if they are related; before, all candidates were shuffled."""
    rng = random.Random(8)
    rows = [(i, f"https://m.{rng.choice(['ünder', 'over'])}.example.net/en/{rng.randrange(3000)}{rng.choice(['', '/', '.html', '?page=2'])}") for i in range(300)]
    df = spark.createDataFrame(rows, "seq_id long, seq string")
    seen, judge = [], candidates._judged
    monkeypatch.setattr(candidates, "_judged", lambda met: seen.append(judge(met)) or seen[-1])
    for block in (candidates.KEY_BLOCK, 30):
        monkeypatch.setattr(candidates, "KEY_BLOCK", block)
        monkeypatch.setattr(candidates, "FEW_PAIRS", 10**9)
        found = SimilarityJoin(df, 4, "edit", l=5).pairs().collect()
        first = {}
        for i, x in rows:
            first.setdefault(x, i)
        want = sorted((i, j) for x, i in first.items() for y, j in first.items() if i < j and levenshtein(x, y) <= 4)
        assert sorted((r.i, r.j) for r in found) == want and len(want) > 300
        copies = [x for _, x in rows]
        assert all(r.n_i == copies.count(rows[r.i][1]) and r.n_j == copies.count(rows[r.j][1]) for r in found)
        assert seen.pop().count() == len(want)
