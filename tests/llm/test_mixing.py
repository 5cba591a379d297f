import random
import re

from nearkin.llm import mixing
from llm_helpers import documents, odd_rows, words


def plain_targets(sizes):
    """Sources in order with weights 5, 2, 1, ...; excess is shared again until no target is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        left = budget - sum(2 * sizes[s] for s in full)
        free = [s for s in order if s not in full]
        target = {s: 2.0 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if target[s] > 2 * sizes[s] + 1e-9]
        if not above:
            return target
        full |= set(above)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows(seed=6):
    rng = random.Random(seed)
    made = [(i, words(rng, int(rng.paretovariate(0.9)) % 400), rng.choice(["s0"] * 6 + ["s1", "s2", "s3", "ä", None])) for i in range(600)]
    return made + [(700 + i, t, s) for i, (_, t, s) in enumerate(made[:40])]


def test_targets_and_picks(spark):
    made = rows()
    sizes = {}
    for _, t, s in made:
        sizes[s] = sizes.get(s, 0) + size(t)
    target = plain_targets(sizes)
    source = {d: s for d, _, s in made}
    picks = mixing.picks(documents(spark, made, clashes=False)).collect()
    assert len(picks) == len(made)
    taken = dict.fromkeys(sizes, 0)
    text = {d: t for d, t, _ in made}
    for r in picks:
        s = source[r["doc_id"]]
        assert r["size"] == size(text[r["doc_id"]]) and r["source_size"] == sizes[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["times"] <= 2
        taken[s] += r["size"] * r["times"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2
    again = mixing.picks(documents(spark, made).repartition(7))
    assert {(r["doc_id"], r["times"]) for r in again.collect()} == {(r["doc_id"], r["times"]) for r in picks}


def test_fill_budget_is_exact_where_it_can_be():
    rng = random.Random(1)
    for _ in range(200):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 6) for _ in sizes]
        reachable = {0}
        for s, c in zip(sizes, counts):
            reachable = {r + s * k for r in reachable for k in range(c + 1)}
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts)))
        taken = mixing.fill_budget(sizes, counts, budget)
        total = sum(s * k for s, k in zip(sizes, taken))
        assert all(0 <= k <= c for k, c in zip(taken, counts)) and total <= budget
        if max(sizes) * max(counts) < 20:
            assert budget - total < max(sizes)
    assert sum(s * k for s, k in zip([3, 7], mixing.fill_budget([3, 7], [5, 5], 29))) == 29


def test_buckets_pick_exactly(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 8)
    made = [(i, "w " * 5, "s" if i % 3 else "t") for i in range(600)]
    picks = mixing.picks(documents(spark, made)).collect()
    target = {s: t for s, t in plain_targets({"s": 2000, "t": 1000}).items()}
    for s, rest in (("s", (1, 2)), ("t", (0,))):
        assert abs(sum(r["size"] * r["times"] for r in picks if (r["doc_id"] % 3) in rest) - target[s]) <= 5


def test_mix_repeats_whole_rows(spark):
    docs = documents(spark, rows(), clashes=True)
    mixed = mixing.mix(docs)
    times = {r["doc_id"]: r["times"] for r in mixing.picks(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and counts == {d: n for d, n in times.items() if n}


def test_odd_rows(spark):
    made = odd_rows()
    assert mixing.picks(documents(spark, made, clashes=True)).count() == len(made)
    assert mixing.mix(documents(spark, made, clashes=True)).count() > 0
    assert mixing.picks(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0


def test_long_documents_get_their_share():
    rng = random.Random(4)
    for share in (0.24, 0.5, 0.76):
        for case in range(6):
            lengths = [int(20 * rng.paretovariate(1.1)) % 12_000 + 1 for _ in range(40 if case == 0 else 3000)]
            sizes = sorted(set(lengths))
            counts = [lengths.count(s) for s in sizes]
            taken = mixing.fill_budget(sizes, counts, round(share * sum(lengths)), case)
            assert sum(s * k for s, k in zip(sizes, taken)) == round(share * sum(lengths)) or case == 0
            if case:
                longest = sorted(lengths)[-len(lengths) // 10]
                words_, of = (sum(s * c for s, c in zip(sizes, x) if s >= longest) for x in (taken, counts))
                assert abs(words_ / of - share) < 0.08
    sizes = list(range(1000, 1100))
    taken = [mixing.fill_budget(sizes, [1] * 100, 52_475, seed) for seed in range(20)]
    assert all(0 < sum(t[k] for t in taken) < 20 for k in (0, 50, 99))
