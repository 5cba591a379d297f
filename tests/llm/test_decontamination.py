import random

from nearkin.llm import decontamination
from llm_helpers import documents, odd_rows, words


def plain_scores(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return row[1:]


def edited(rng, text, edits):
    symbols = list(text)
    for _ in range(edits):
        i, how = rng.randrange(len(symbols)), rng.random()
        if how < 0.33:
            symbols[i] = "z"
        elif how < 0.66:
            del symbols[i]
        else:
            symbols.insert(i, "q")
    return "".join(symbols)


def test_bit_parallel_scores_match_the_table():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        assert list(decontamination._scores(item, text, False)) == plain_scores(item, text)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string, doc_id string")


def test_matches_are_those_within_the_budget(spark):
    rng = random.Random(2)
    items = [(i, words(rng, rng.randint(1, 40)), "x") for i in range(12)] + [(50, None, "x"), (51, "", "x"), (None, words(rng, 30), "x")]
    rows = []
    for i in range(80):
        item = decontamination.normalise(rng.choice(items[:12])[1])
        part = edited(rng, item, rng.randint(0, int(0.16 * len(item)))) if len(item) > 9 else item
        rows.append((i, words(rng, 12).upper() + " \n " + part.replace(" ", "\t ") + "  " + words(rng, 9), "s"))
    docs = documents(spark, rows + odd_rows(), clashes=True)
    found = decontamination.find_passages(docs, benchmark(spark, items)).collect()
    text = {d: t for d, t, _ in rows}
    wanted = set()
    for d, t in text.items():
        low = decontamination.normalise(t)
        for item_id, item, _ in items:
            item = decontamination.normalise(item or "")
            if item and min(plain_scores(item, low)) <= int(0.08 * len(item)):
                wanted.add((d, item_id))
    assert {(r["doc_id"], r["item_id"]) for r in found if r["doc_id"] in text and r["doc_id"] < 80} == {
        w for w in wanted
    } | {(r["doc_id"], r["item_id"]) for r in found if (r["doc_id"], r["item_id"]) in wanted}
    whole = {i: decontamination.normalise(t or "") for i, t, _ in items}
    for r in found:
        if r["doc_id"] in text and r["distance"] == 0:
            passage = text[r["doc_id"]][r["start"] : r["end"]]
            assert decontamination.normalise(passage) == whole[r["item_id"]] and passage == passage.strip()


def test_blocks_of_items_find_the_same(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, words(rng, 20), "x") for i in range(10)]
    rows = [(i, words(rng, 5) + " " + items[i % 10][1] + " " + words(rng, 5), "s") for i in range(20)]
    rows += [(100 + i, words(rng, 40), "s") for i in range(5)]
    docs = documents(spark, rows, clashes=True)
    one = decontamination.find_passages(docs, benchmark(spark, items)).collect()
    monkeypatch.setattr(decontamination, "BLOCK_SYMBOLS", 300)
    assert sorted(one) == sorted(decontamination.find_passages(docs, benchmark(spark, items)).collect())
    clean = decontamination.drop_contaminated(docs, benchmark(spark, items))
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [100, 101, 102, 103, 104]


def test_empty(spark):
    none, some = benchmark(spark, []), benchmark(spark, [(1, "some words", "x")])
    docs = documents(spark, odd_rows(), clashes=True)
    assert decontamination.find_passages(docs, none).count() == 0
    assert decontamination.drop_contaminated(docs, none).count() == docs.count()
    assert decontamination.find_passages(documents(spark, []), some).count() == 0
