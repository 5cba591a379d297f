"""Profiles, graph operators, the command line, and the registered queries' contract."""

import hashlib
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from nearkin.cli import main, parser, run
from nearkin.operators import graph, index, profile
from nearkin.sources.fasta import read_fasta

# Folder of published sample files, where there is one.
DATA = os.environ.get("NEARKIN_SAMPLES", "")

# Digests of the sample files' consensus strings.
CONSENSUS = {
    "query1/close.fas": "da7f4fd9a1343eaddf7baecd34b893b1",
    "query2/medium.fas": "afc69ddf2a40f7c4f635a9154589cbc6",
    "query3/far.fas": "80d44aa574b08ec5178668f223aa086f",
}


def test_golden_consensus(spark):
    for file, digest in CONSENSUS.items() if DATA else ():
        reads = read_fasta(spark, f"{DATA}/{file}")
        for found in (profile.consensus(reads, "seq"), profile.profile_consensus(profile.profile(reads, "seq"))):
            assert hashlib.md5(found.first().consensus.encode()).hexdigest() == digest


def test_profile_of_mixed_strings(spark):
    df = spark.createDataFrame([("AC",), ("AN",), ("G",), ("T-",)], "seq string")
    prof = profile.profile(df, "seq")
    found = {(r.pos, r.sym): r.freq for r in prof.collect()}
    assert len(found) == 8
    assert {k: v for k, v in found.items() if v} == {(0, "A"): 0.5, (0, "G"): 0.25, (0, "T"): 0.25, (1, "C"): 0.25}
    assert profile.consensus(df, "seq", [], "ACGTN").first().consensus == "AC"
    only = spark.createDataFrame([("A-",), ("C-",)], "seq string")
    assert profile.profile_consensus(profile.profile(only, "seq")).first().consensus == "A$"
    assert {r.pos: r.major for r in profile.major_allele(profile.profile(only, "seq")).collect()} == {0: 0, 1: -1}


def _graph(seed, n, p):
    rng = random.Random(seed)
    return [(i, j) for i, j in itertools.combinations(range(n), 2) if rng.random() < p]


def _components(n, edges):
    label = list(range(n))
    for _ in range(n):
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    order = {r: at + 1 for at, r in enumerate(sorted(set(label)))}
    return {v: order[label[v]] for v in range(n)}


def _cliques(n, edges):
    linked = set(edges) | {(j, i) for i, j in edges}
    whole = [set(c) for r in range(2, n + 1) for c in itertools.combinations(range(n), r) if all((i, j) in linked for i, j in itertools.combinations(c, 2))]
    return {tuple(sorted(c)) for c in whole if not any(c < d for d in whole)}


@pytest.mark.parametrize("seed, p", [(1, 0.1), (2, 0.4), (3, 0.75)])
def test_graph_operators(spark, seed, p):
    n, edges = 11, _graph(seed, 11, p)
    frame = spark.createDataFrame(edges + [(j, i) for i, j in edges[::2]] + edges[:2], "i int, j int")
    found = graph.connected_components(spark.range(n).select(F.col("id").cast("int")), frame)
    assert {r.vertex: r.component for r in found.collect()} == _components(n, edges)
    for split in (graph.SPLIT_ENTRIES, 6):
        cliques = [tuple(r.clique) for r in graph.maximal_cliques(frame, split).collect()]
        assert len(cliques) == len(set(cliques))
        assert set(cliques) == _cliques(n, edges)


def test_long_chain_is_one_component(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(200)], "i int, j int")
    found = graph.connected_components(spark.range(202).select(F.col("id").cast("int")), frame)
    assert {r.component for r in found.where("vertex <= 200").collect()} == {1}
    assert found.where("vertex = 201").first().component == 2


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fas").write_text(">1\nACGTACGTAC\n>2\nACGTACGTAA\n>3\nTTTTTTTTTT\n")
    (tmp_path / "in" / "b.fas").write_text(">1\nTTTTTTTTTA\n")
    out = str(tmp_path / "out")

    def lines(name):
        return sorted(r[0] for r in spark.read.text(f"{out}/{name}").collect())

    for mode, name in [("edit-single", "signature"), ("hamming-single", "signature-hamming"), ("brute-edit-single", "brute")]:
        run(spark, parser().parse_args(["-m", mode, "-in", str(tmp_path / "in" / "a.fas"), "-k", "1", "-l", "4", "-outDir", out]))
        assert lines(f"a-{name}-output.txt") == ["0 1"]
    printed = capsys.readouterr().out
    assert "related pairs = 1" in printed
    assert all(int(line.split()[2][:-1]) > 0 for line in printed.splitlines() if line.startswith("Peak memory"))
    assert printed.count("Peak memory") == 3
    for mode, name in [("edit-multi", "signature"), ("hamming-multi", "signature-hamming")]:
        run(spark, parser().parse_args(["-m", mode, "-in", str(tmp_path / "in"), "-k", "1", "-l", "4", "-outDir", out]))
        rows = spark.read.text(f"{out}/multi-{name}-output.txt").collect()
        assert [tuple(r) for r in rows] == [("2 0", "a", "b")]
    for argv in (["-help"], [], ["-m", "other"]):
        with pytest.raises(SystemExit) as stop:
            main(argv)
        assert stop.value.code == 1
    assert run(spark, parser().parse_args(["-m", "edit-single", "-in", str(tmp_path / "none")])) is None
    assert run(spark, parser().parse_args(["-m", "edit-multi", "-in", str(tmp_path / "none")])) is None


def test_registered_queries_are_named_alike():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cliques_of_negative_and_sparse_ids(spark):
    edges = [(-1, -2), (-2, -3), (-1, -3), (-3, 10**12), (5, -(10**15))]
    found = {tuple(r.clique) for r in graph.maximal_cliques(spark.createDataFrame(edges, "i bigint, j bigint")).collect()}
    assert found == {(-3, -2, -1), (-3, 10**12), (-(10**15), 5)}
    vertices = spark.createDataFrame([(v,) for v in (-1, -2, -3, 10**12, 5, -(10**15), 77)], "v bigint")
    parts = graph.connected_components(vertices, spark.createDataFrame(edges, "i bigint, j bigint")).collect()
    assert {r.vertex: r.component for r in parts} == {-(10**15): 1, 5: 1, -3: 2, -2: 2, -1: 2, 10**12: 2, 77: 3}


def test_hub_is_searched_by_many_tasks(spark):
    # Two hubs see each other and 3000 vertices, which are chained in pairs; both are earlier or later than many.
    n = 3000
    edges = [(0, 1)] + [(h, v) for h in (0, 1) for v in range(2, n + 2)] + [(v, v + 1) for v in range(2, n + 2, 2)]
    frame = spark.createDataFrame(edges, "i int, j int")
    found = graph.maximal_cliques(frame, 1).withColumn("task", F.spark_partition_id()).collect()
    assert {tuple(r.clique) for r in found} == {(0, 1, v, v + 1) for v in range(2, n + 2, 2)}
    assert len({r.task for r in found}) > 1
    # Everybody knows everybody: one clique, found once, whatever the first two members are.
    whole = spark.createDataFrame(list(itertools.combinations(range(40), 2)), "i int, j int")
    for split in (graph.SPLIT_ENTRIES, 1):
        assert [r.clique for r in graph.maximal_cliques(whole, split).collect()] == [list(range(40))]


def test_earlier_vertices_alike_are_one_row(spark):
    edges = [(0, 1), (0, 2), (1, 2)] + [(h, v) for h in (0, 1, 2) for v in range(10, 400)]
    around = graph._neighbourhoods(graph._oriented(spark.createDataFrame(edges, "i int, j int")))
    units = graph._units(around, graph.SPLIT_ENTRIES).where("vertex is null")
    # 390 vertices come before 0, 1 and 2 and are next to all of them.
    assert units.count() == 2
    assert graph.maximal_cliques(spark.createDataFrame(edges[:0], "i int, j int")).count() == 0


def test_related_samples_of_mixed_lengths(spark):
    rows = [("a", "ACGTACGA"), ("a", "TTTTCCCCGGGGAAAATTTTCCCCGGGGAAAATTTTCCCC"), ("b", "ACGTACGA"), ("c", "GG"), ("d", "CATCATCATCATCAT")]
    df = spark.createDataFrame(rows, "sample string, seq string")
    found = {(r.sample1, r.sample2) for r in index.related_samples(df, "sample", "seq", 4, 1).collect()}
    assert ("a", "b") in found and {("c", "d")} <= found and ("a", "d") not in found


def test_coincidences_of_many_samples(spark):
    # More samples than a word has bits; one l-mer is in every sample, at several places of most.
    rng = random.Random(9)
    rows = [(f"s{n:03}", "ACGT" * rng.randint(1, 3) + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 14)))) for n in range(150) for _ in range(2)]
    df = spark.createDataFrame(rows + [(None, "ACGTACGT"), ("s000", None), ("t", ""), ("u", "TTTT")], "sample string, seq string")
    places, held = {}, {}
    for sample, seq in rows + [("u", "TTTT")]:
        for at in range(len(seq) // 4):
            places.setdefault(sample, {}).setdefault(at, set()).add(seq[4 * at : 4 * at + 4])
        held.setdefault(sample, set()).update(seq[at : at + 4] for at in range(len(seq) - 3))
    wanted = {(a, b): sum(bool(at & held[b]) for at in places[a].values()) for a in places for b in held if a < b}
    found = {(r.sample1, r.sample2): r.coincidences for r in index.sample_coincidences(df, "sample", "seq", 4).collect()}
    assert found == {pair: n for pair, n in wanted.items() if n} and len(found) > 150 * 149 // 2 - 1
    assert index.sample_coincidences(df.limit(0), "sample", "seq", 4).count() == 0


def test_index_and_consensus_in_one_count(spark):
    rng = random.Random(4)
    rows = [(s, "".join(rng.choice("ACGTN-") for _ in range(rng.randint(0, 30)))) for s in "ab" for _ in range(40)] + [("c", ""), ("a", None)]
    df = spark.createDataFrame(rows, "sample string, seq string")
    frequencies, called = profile.index_and_consensus(df, "seq", 3, ["sample"])
    assert sorted(map(tuple, frequencies.collect())) == sorted(map(tuple, index.lmer_frequency(df, "seq", 3, ["sample"]).collect()))
    assert sorted(map(tuple, called.collect())) == sorted(map(tuple, profile.consensus(df, "seq", ["sample"]).collect()))
    whole, one = profile.index_and_consensus(df.limit(0), "seq", 3)
    assert whole.count() == 0 and one.collect() == profile.consensus(df.limit(0), "seq").collect()


def test_chunk_frequencies_are_not_broadcast(spark):
    """The table behind them is small, but there may be many more chunks than rows."""
    rows = spark.createDataFrame([(i, "ACGT" * 5 + "ACGA"[i % 4] * 4) for i in range(20)], "id bigint, seq string")
    probes = index.chunk_rows(rows, index.equal_chunks("seq", 4), ["id"]).withColumnRenamed("chunk", "lmer")
    ranked = index.ranked_chunks(probes, index.lmer_frequency(rows, "seq", 4), "id", ["lmer"])
    assert "Broadcast" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.count() == 120 and ranked.where("rank = 6").select("freq").distinct().collect()[0].freq == 20


def test_grams_of_keys_of_one_row_and_of_several(spark):
    """Counted before they are rows: keys of one row are not shuffled, pairs get texts instead of grams."""
    from collections import Counter

    from nearkin.operators import qgram

    texts = [(1, "aab  aab\n\taab"), (2, "aab éé aab\U0001f600aab"), (3, None), (4, ""), (5, "aa"), (6, "x" * 3000 + "aab aab"), (7, "b aab")]
    doubled = texts + [(2, "aab"), (None, "aabc"), (None, "aab")]
    for rows in (texts, doubled):
        df = spark.createDataFrame(rows, "id bigint, text string")
        wanted = {}
        for key, text in rows:
            plain = " ".join(filter(None, ["".join(" " if c.isspace() else c for c in text or "")]))
            while "  " in plain:
                plain = plain.replace("  ", " ")
            wanted.setdefault(key, Counter()).update(plain[i : i + 3] for i in range(len(plain) - 2))
        found = {}
        for r in qgram.qgram_profile(df, "id", "text").collect():
            assert (r.id, r.gram) not in found
            found[r.id, r.gram] = r.cnt
        assert found == {(k, g): n for k, c in wanted.items() for g, n in c.items()}
        ids = [i for i, _ in texts]
        pairs = spark.createDataFrame([(i, j) for i in ids for j in ids], "x bigint, y bigint")
        got = {(r.x, r.y): r.similarity for r in qgram.text_similarity(pairs, "x", "y", df, "id", "text").collect()}
        assert got == {(i, j): sum((wanted[i] & wanted[j]).values()) for i in ids for j in ids}
    single = qgram.qgram_profile(spark.createDataFrame(texts, "id bigint, text string"), "id", "text")
    assert "Aggregate" not in single._jdf.queryExecution().executedPlan().toString()


def test_lmers_are_distinct_before_they_are_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), "".join(rng.choice("abcé\U0001f600") for _ in range(rng.choice([0, 3, 4, 50, 900])))) for _ in range(60)] + [("a", None)]
    df = spark.createDataFrame(rows, "name string, text string")
    for l in (1, 4, 40):
        found = [tuple(r) for r in index.distinct_lmers(df, "text", l, ["name"]).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(n, t[i : i + l]) for n, t in rows if t for i in range(len(t) - l + 1)}
    assert "Generate" not in index.distinct_lmers(df, "text", 4, ["name"])._jdf.queryExecution().executedPlan().toString()


def test_few_partitions_of_long_strings_are_spread(spark, monkeypatch):
    from nearkin import session

    monkeypatch.setattr(session, "TASK_SYMBOLS", 100)
    df = spark.createDataFrame([(i, f"{i:04d}ACGT" * 10) for i in range(40)], "id bigint, seq string").coalesce(1)
    assert index.lmer_index(df, "seq", 12, ["id"]).rdd.getNumPartitions() == 32
    assert session.spread(df.limit(1), "seq").rdd.getNumPartitions() == 1
    assert index.lmer_index(df, "seq", 12, ["id"]).count() == index.distinct_lmers(df, "seq", 12, ["id"]).count()
