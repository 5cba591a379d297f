import random
import re

import numpy as np

from nearkin.llm import pii
from llm_helpers import documents, odd_rows, words

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def plain(text):
    spans = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            passed = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(digits) <= 19 and luhn(digits),
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if passed:
                spans.append((kind, *m.span()))
    return spans


def test_base_spans_match_the_patterns():
    rng = random.Random(2)
    for _ in range(30_000):
        text = "".join(rng.choice("a.@-+ 12()9.14é") for _ in range(rng.randint(1, 60)))
        assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "a1" * 100_000, "-" * 100_000 + "1"):
        pii.candidates(text, pii.base_spans(text))


def test_classifier_adds_secrets_and_leaves_clean_text(spark):
    rng = random.Random(3)
    rows, secret, numbers = [], set(), set()
    for i in range(240):
        text = words(rng, 20)
        if i % 4 == 0:
            value = f"{rng.getrandbits(160):040x}"
            text += f' token = "{value}" ' + words(rng, 5)
            secret.add(i)
        elif i % 4 == 1:
            text += " AKIA" + "".join(rng.choice("ABCDEFGH234567") for _ in range(16)) + " " + words(rng, 5)
        elif i % 4 == 2:
            text += f" {rng.randint(10**15, 10**16 - 1)} version 3.1 of 2024-05-17 " + words(rng, 5)
            numbers.add(i)
        rows.append((i, text, "s"))
    found = {r["doc_id"]: r for r in pii.find(documents(spark, rows, clashes=True)).collect()}
    for d, text, _ in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in found[d]["spans"]]
        base = plain(text)
        assert [(s["kind"], s["start"], s["end"]) for s in found[d]["base"]] == base and spans[: len(base)] == base
        if d in secret:
            a, b = next((a, b) for k, a, b in spans if k == "secret")
            assert re.fullmatch("[0-9a-f]{40}", text[a:b])
        elif d % 4 != 1:
            assert spans == base


def test_expectation_maximisation_finds_the_better_labeler():
    rng = np.random.default_rng(4)
    votes = {}
    for _ in range(4000):
        yes = rng.random() < 0.4
        good = [("+" if yes else "-") if rng.random() < 0.95 else ("-" if yes else "+") for _ in range(3)]
        poor = "+-"[rng.integers(2)]
        combination = "".join([*good, poor, "0"])
        votes[combination] = votes.get(combination, 0) + 1
    yes, rates = pii.reliabilities(list(votes), list(votes.values()))
    assert rates[0, 1, 2] > 0.9 and rates[0, 0, 0] > 0.9 and abs(rates[3, 1, 2] - 0.5) < 0.1
    assert abs(sum(y * n for y, n in zip(yes, votes.values())) / 4000 - 0.4) < 0.03


def test_odd_rows(spark):
    made = odd_rows()
    found = pii.find(documents(spark, made, clashes=True)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(d) for d, _, _ in made)
    assert pii.find(documents(spark, [])).count() == 0


def proposed(text):
    return [text[a:b] for _, a, b, _, _ in pii.candidates(text, pii.base_spans(text))]


def test_announced_values_are_proposed():
    assert proposed("password=hunter and the pin 1234.") == ["hunter", "1234"]
    assert proposed("Token: 'abcxyzabc' password: 12aa45bbcc") == ["abcxyzabc", "12aa45bbcc"]
    assert proposed("call them, key: value, account closed, access 2023, token ring, spin 1234, pin: 12") == []


def test_a_token_is_judged_whole():
    token = "a" * 5000
    votes = [pii.candidates(f"x {token}{tail}", [])[0][3:] for tail in ("1", "1b2c3d4e5")]
    assert votes[0] != votes[1]


def test_recall_of_planted_secrets(spark):
    """Announced secrets of kinds that no format describes, and clean lines with the same words."""
    rng = random.Random(12)
    rows, planted = [], {}
    for i in range(600):
        text = words(rng, 30)
        word, value = rng.choice(["password", "token", "secret", "api_key"]), "".join(rng.choice("abcdefghkmnp") for _ in range(rng.randint(6, 12)))
        if i % 3 == 0:
            planted[i] = value
            text += f" {word}{rng.choice(['=', ': ', ' = '])}{value} " + words(rng, 5)
        elif i % 3 == 1:
            planted[i] = str(rng.randint(1000, 999_999))
            text += f" pin {planted[i]} " + words(rng, 5)
        else:
            text += f" the {word} of {value} in {rng.randint(1990, 2026)} and call {rng.randint(1, 99)} " + words(rng, 5)
        rows.append((i, text, "s"))
    texts = {d: t for d, t, _ in rows}
    found = {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"]] for r in pii.find(documents(spark, rows)).collect()}
    assert sum(v in found[d] for d, v in planted.items()) >= 0.95 * len(planted)
    assert not any(found[d] for d in texts if d not in planted)
