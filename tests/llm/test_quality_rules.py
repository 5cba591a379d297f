import collections
import random
import re

from nearkin.llm import quality_rules
from llm_helpers import documents, odd_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = collections.Counter(runs)
    covered = {j for i, r in enumerate(runs) if counts[r] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def rows():
    rng = random.Random(2)
    made = odd_rows()
    for i in range(60):
        line = words(rng, rng.randint(1, 12))
        text = "\n".join(rng.choice([line, words(rng, rng.randint(0, 9)), "", " ", "#* | <x>"]) for _ in range(rng.randint(0, 12)))
        made.append((100 + i, text, "s"))
    return made


def test_statistics_match_plain_python(spark):
    made = rows()
    judged = quality_rules.judge(documents(spark, made, clashes=True)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(repr((r["doc_id"], *[r[c] for c in names])) for r in judged) == sorted(repr((d, *plain(t))) for d, t, _ in made)
    assert all(r["kept"] == (not r["failed"]) and (not r["base_failed"] or not r["kept"]) for r in judged)


def test_kept_rows_keep_their_columns(spark):
    docs = documents(spark, rows(), clashes=True)
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns
    passing = quality_rules.judge(documents(spark, rows())).where("kept").count()
    assert kept.count() == passing > 0


def test_rules_tell_running_text_from_junk(spark):
    rng = random.Random(3)
    stop = quality_rules.STOP_WORDS["en"]
    good = " ".join(rng.choice([rng.choice(stop), words(rng, 1)]) for _ in range(200))
    texts = [good, " ".join(w + "###" for w in good.split()), good.upper(), " ".join(["again"] * 200), "1 2 3 4 5 6 7 8 9 10 11 12"]
    judged = quality_rules.judge(documents(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {0}


def test_no_python_on_the_executors(spark):
    plan = quality_rules.keep_passing(documents(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(spark):
    assert quality_rules.judge(documents(spark, [])).count() == 0
