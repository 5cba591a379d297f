import random

import corpus_pipeline
from nearkin.llm import simhash, similar
from llm_helpers import documents, odd_rows, words


def plain_components(rows):
    def runs(text):
        low = (text or "").encode().lower().split()
        return {tuple(low[i : i + 5]) for i in range(max(1, len(low) - 4))} if low else set()

    sets = [runs(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), str(least[find(i)])) for i, (d, _, _) in enumerate(rows))


def near_rows(seed=3):
    """Copies on both sides of 0.8, one passage in all, one large group of near copies."""
    rng = random.Random(seed)
    passage, rows = words(rng, 40), []
    for i in range(40):
        base = words(rng, rng.choice([4, 7, 30, 120, 300])).split()
        for j in range(6):
            copy = list(base)
            for _ in range(j * len(base) // 90 + (j > 3)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((i * 10 + j, " ".join(copy) + (" " + passage if i % 2 else ""), "s"))
    base = words(rng, 150).split()
    for i in range(60):
        at = rng.randrange(150)
        rows.append((1000 + i, " ".join(base[:at] + [words(rng, 1)] + base[at + 1 :]), "s"))
    return rows + [(2000 + i, t, s) for i, (_, t, s) in enumerate(rows[:5])]


def test_stage_links_every_pair_of_similarity_four_fifths(spark):
    rows = near_rows()
    wanted = plain_components(rows)
    assert len(rows) // 6 < len({c for _, c in wanted}) < len(rows) - 100
    docs = documents(spark, rows)
    kept = corpus_pipeline.deduplicate(spark, docs, "")
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted({c for _, c in wanted})


def test_odd_rows_and_empty_tables(spark):
    found = similar.near_duplicates(documents(spark, odd_rows(), clashes=True)).select("doc_id", "component_id").collect()
    assert sorted((str(r[0]), str(r[1])) for r in found) == plain_components(odd_rows())
    assert similar.keep_one(documents(spark, [])).count() == 0


def test_every_order_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(similar, "OFTEN", 10**9)
    monkeypatch.setattr(similar, "first_pairs", lambda v: v.selectExpr("v i", "v j").limit(0).transform(lambda d: similar.materialize(d, "none")))
    rows = near_rows(4)
    found = similar.near_duplicates(documents(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted((str(r[0]), str(r[1])) for r in found) == plain_components(rows)


def test_no_component_is_lost(spark):
    """Null ids, one id with two texts, identical rows: one row of each component stays."""
    rng = random.Random(21)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(None, a, "s"), (None, b, "s"), (1, c, "s")]
    assert sorted(r["text"] for r in similar.keep_one(documents(spark, rows)).collect()) == sorted([a, b, c])
    rows = [(2, a, "s"), (5, a, "s"), (5, b, "s"), (7, d, "s"), (7, d, "s"), (None, d, "s"), (None, c, "s"), (None, c, "s")]
    kept = similar.keep_one(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("2", a), ("5", b), ("7", d), ("None", c)])


def test_bitmaps_rule_out_no_similar_sets():
    rng = random.Random(12)
    for _ in range(3000):
        n = rng.choice([1, 5, 60, 63, 64, 65, 200, 900])
        base = words(rng, n + 4).split()
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randint(0, 2)] = words(rng, rng.randint(1, 2)).split()
        x, y = (similar.shingles(" ".join(t).encode()) for t in (base, copy))
        alike = len(set(x.tolist()) & set(y.tolist())) * 5 >= 4 * len(set(x.tolist()) | set(y.tolist()))
        assert similar.may_fit(similar._bitmap(x), similar._bitmap(y), len(x) + len(y)) or not alike
    x, y = (similar.shingles(words(rng, 300).encode()) for _ in range(2))
    assert not similar.may_fit(similar._bitmap(x), similar._bitmap(y), len(x) + len(y))


def test_fingerprints_bring_pairs_together(spark):
    """The pipeline's stage links by SimHash and an exact check: pairs of at most three bits are proposed and judged."""
    rng = random.Random(17)
    base = words(rng, 800).split()
    rows = [(i, " ".join(base[:at] + [words(rng, 1)] + base[at + 1 :]), "s") for i, at in enumerate(range(0, 800, 40))]
    docs = documents(spark, rows)
    vertices = similar.materialize(similar._described(docs), "vertices").dropDuplicates(["v"])
    prints = {r["v"]: r["fp"] % 2**64 for r in vertices.collect()}
    pairs = {(r["i"], r["j"]) for r in similar.fingerprint_pairs(vertices).collect()}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}
    assert near and pairs <= near and len(pairs) >= len({p for p in prints.values()}) - len({a for a, _ in near} | {b for _, b in near})
    found = similar.near_duplicates(docs).select("doc_id", "component_id").collect()
    assert sorted((str(r[0]), str(r[1])) for r in found) == plain_components(rows)


def test_parities_never_rule_out_a_link():
    rng = random.Random(23)
    for _ in range(200):
        base = words(rng, rng.choice([3, 20, 200, 1500])).encode().split()
        other = list(base)
        for _ in range(rng.choice([0, 1, 2, len(base) // 60])):
            other[rng.randrange(len(other))] = words(rng, 1).encode()
        x, y = (similar.shingles(b" ".join(t)) for t in (base, other))
        if 9 * len(set(x) & set(y)) >= 4 * (len(x) + len(y)):
            odd = sum(int(w).bit_count() for w in similar._words(x) ^ similar._words(y))
            assert 9 * odd <= len(x) + len(y)


def test_centers_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOLDERS", 3)
    monkeypatch.setattr(similar, "first_pairs", lambda v: v.selectExpr("v i", "v j").limit(0).transform(lambda d: similar.materialize(d, "none")))
    rows = near_rows(seed=7)
    found = similar.near_duplicates(documents(spark, rows)).select("doc_id", "component_id").collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == plain_components(rows)


def test_copies_of_one_group_do_not_all_meet(spark, monkeypatch):
    """Near copies that share most keys of a group: before, each met all others."""
    rng = random.Random(4)
    base, rows = words(rng, 300).split(), []
    for i in range(240):
        at = rng.randrange(300)
        rows.append((i, " ".join([*base[:at], f"stray{i}", *base[at + 1 :]]), None))
    docs = documents(spark, rows)
    vertices = similar.materialize(similar._described(docs).dropDuplicates(["v"]), "vertices")
    monkeypatch.setattr(similar, "HOLDERS", 20)
    alone = vertices.selectExpr("v vertex", "v root")
    apart = similar._rows(similar._shared_keys(vertices), alone, vertices)
    pairs = [(r["i"], r["j"]) for r in similar.met_pairs(apart, docs, vertices).collect()]
    assert len(pairs) < 5 * 240
    assert len({v for pair in pairs for v in pair}) == 240


def test_links_of_fingerprints_stay(spark):
    """Texts that op1 links are one component, also below similarity 0.8; before, its links had to pass that check."""
    rng = random.Random(31)
    rows = []
    for family in range(40):
        base = words(rng, 700).split()
        for member, changed in enumerate((0, 26, 30, 34, 40)):
            copy = list(base)
            for at in rng.sample(range(0, 700, 5), changed):
                copy[at] = words(rng, 1)
            rows.append((10 * family + member, " ".join(copy), "s"))
    prints = [simhash.fingerprint(t.encode()) for _, t, _ in rows]
    sets = [set(similar.shingles(t.encode()).tolist()) for _, t, _ in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    below = [(i, j) for i, j in near if 5 * len(sets[i] & sets[j]) < 4 * len(sets[i] | sets[j])]
    plain = dict(plain_components(rows))
    assert any(plain[str(rows[i][0])] != plain[str(rows[j][0])] for i, j in below)
    wanted = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(documents(spark, rows), prints=True).collect()}
    assert all(wanted[rows[i][0]] == wanted[rows[j][0]] for i, j in near)
    kept = corpus_pipeline.deduplicate(spark, documents(spark, rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted.values())) and len(kept) < len(set(plain.values()))


def test_a_pair_leaves_the_joins_about_once(spark, monkeypatch):
    """Large sets around the threshold share many keys; before, a pair left the join for each of them."""
    rng = random.Random(37)
    base, rows = words(rng, 900).split(), []
    for i in range(12):
        copy = list(base)
        for at in rng.sample(range(900), 4 + 2 * i):
            copy[at] = words(rng, 1)
        rows.append((i, " ".join(copy), "s"))
    docs = documents(spark, rows)
    vertices = similar.materialize(similar._described(docs).dropDuplicates(["v"]), "vertices")
    left, named = [], similar._named
    monkeypatch.setattr(similar, "_named", lambda met: left.append(met.count()) or named(met))
    apart = similar._rows(similar._shared_keys(vertices), vertices.selectExpr("v vertex", "v root"), vertices)
    pairs = {(r["i"], r["j"]) for r in similar.met_pairs(apart, docs, vertices).collect()}
    sets = {r["v"]: set(similar.shingles(rows[r["doc_id"]][1].encode()).tolist()) for r in vertices.collect()}
    alike = {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert alike and alike <= pairs and sum(left) <= 2 * len(pairs)
