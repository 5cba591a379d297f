"""The whole-text join against brute force; and the shared folder."""

import os
import random

import __spark_entry__ as entry
from nearkin import session


def within(x, y, k):
    """Levenshtein distance at most ``k``, looking only at the diagonals that matter."""
    if abs(len(x) - len(y)) > k:
        return False
    row = {j: j for j in range(k + 1)}
    for i, a in enumerate(x, 1):
        following = {}
        for j in range(max(0, i - k), min(len(y), i + k) + 1):
            best = i if j == 0 else row.get(j - 1, k + 1) + (a != y[j - 1])
            following[j] = min(best, row.get(j, k + 1) + 1, following.get(j - 1, k + 1) + 1)
        row = following
    return row.get(len(y), k + 1) <= k


def test_document_join_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    words = ["lorem", "ipsum", "größe", "日本", "dolor", "sit", "amet", "the", "of", "\n"]
    rows = []
    for family in range(9):
        base = list(" ".join(rng.choice(words) for _ in range([1, 3, 12, 40, 90, 115, 125, 160, 400][family])))
        for member in range(5):
            text = list(base)
            for _ in range(rng.choice([0, 2, 4, 6, 9]) if member else 0):
                p = rng.randrange(len(text) + 1)
                if rng.random() < 0.5 and p < len(text):
                    del text[p]
                else:
                    text.insert(p, rng.choice("xyzé "))
            rows.append((len(rows), "".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for i, x in rows:
        first.setdefault(x, i)
    want = {(i, j) for x, i in first.items() for y, j in first.items() if i < j and within(x, y, 8)}
    found = entry.queries()["document_edit_join"](spark, str(tmp_path)).collect()
    assert {(r.i, r.j) for r in found} == want and len(found) == len(want) > 9
    copies = [x for _, x in rows]
    assert all(r.n_i == copies.count(rows[r.i][1]) and r.n_j == copies.count(rows[r.j][1]) for r in found)


def test_intermediate_tables_go_to_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder
    assert session.materialize(spark.range(3), "probe").count() == 3
    assert any(d.startswith("probe-") for d in os.listdir(folder))
