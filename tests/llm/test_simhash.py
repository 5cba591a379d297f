import random

import xxhash

from nearkin.llm import simhash
from llm_helpers import documents, odd_rows, words


def plain_fingerprint(text):
    low = (text or "").encode().lower().split()
    runs = [b" ".join(low[i : i + 3]) for i in range(len(low) - 2)] or ([b" ".join(low)] if low else [])
    h = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((str(d), f"{fps[i]:016x}", str(least[find(i)])) for i, (d, _, _) in enumerate(rows))


def near_rows(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(12):
        base = words(rng, 400).split()
        for j in range(6):
            copy = list(base)
            for _ in range(j):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((i * 10 + j, " ".join(copy), "s"))
    return rows + [(1000 + i, t, s) for i, (_, t, s) in enumerate(rows[:5])]


def test_components_match_brute_force(spark):
    for rows in (near_rows(), odd_rows()):
        found = simhash.near_duplicates(documents(spark, rows, clashes=True)).select("doc_id", "fingerprint", "component_id").collect()
        assert sorted((str(r[0]), r[1], str(r[2])) for r in found) == plain_components(rows)


def test_links_are_complete_and_single(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(12):
            value = centre
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            fps.add(value - (1 << 64) if value >> 63 else value)
    found = [tuple(r) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).collect()]
    order = sorted(fps)
    wanted = {(a, b) for i, a in enumerate(order) for b in order[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(found) == len(set(found)) and set(found) == wanted


def test_dense_ball_is_one_component(spark):
    # All values within one bit of a centre: many links between few anchors.
    fps = [0] + [(1 << b) - (1 << 64 if b == 63 else 0) for b in range(64)]
    assert simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint")).count() == 65 * 64 // 2


def test_keep_one(spark):
    rows = near_rows()
    docs = documents(spark, rows, clashes=True)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({int(c) for _, _, c in plain_components(rows)})


def test_empty(spark):
    empty = documents(spark, [])
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_no_component_is_lost(spark):
    """Null ids, one id with two texts, identical rows: one row of each component stays."""
    rng = random.Random(21)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    rows = [(None, a, "s"), (None, b, "s"), (1, c, "s")]
    assert sorted(r["text"] for r in simhash.keep_one(documents(spark, rows)).collect()) == sorted([a, b, c])
    rows = [(2, a, "s"), (5, a, "s"), (5, b, "s"), (7, d, "s"), (7, d, "s"), (None, d, "s"), (None, c, "s"), (None, c, "s")]
    kept = simhash.keep_one(documents(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == sorted([("2", a), ("5", b), ("7", d), ("None", c)])
