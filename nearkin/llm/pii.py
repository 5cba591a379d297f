"""Personal data: fixed patterns, and spans found by weak supervision.

The base kinds (email, ip, card, phone) are patterns with a check and always count. For other
personal data, such as secrets and local numbers, candidate spans are collected and several
labelers vote on each: formats (patterns), words that announce a secret (gazetteer), the context in
front of it, its shape, and a numeric check. Expectation-maximisation estimates from the votes alone
how reliable each labeler is and how likely each combination of votes is right. With these as soft
labels, a logistic regression on the span's features becomes the classifier that decides.

Votes and features take few values, so the corpus is reduced to counts of their combinations, over
all documents; only those counts reach the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.llm.common import map_batches
from nearkin.session import materialize

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "local_phone", "ssn", "number")
# Probability from which the classifier's span counts.
CUT = 0.5
# Shortest candidate in symbols.
SHORTEST = 9
# Words whose announced value needs no digit.
STRONG = frozenset("password passwd pwd secret token apikey api_key credential".split())
# Words that announce a value without a sign in between.
DIRECT = frozenset("password passwd pwd pin ssn iban phone tel telephone mobile fax".split())
TRIGGERS = frozenset("password passwd pwd token secret key apikey api_key access auth bearer credential ssn phone tel telephone call mobile fax account iban pin".split())
LABELERS = ("format", "gazetteer", "context", "shape", "check")

_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_NAME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A run of digits is only tried from its start: a match takes whole runs, and where a run fails, so do its ends.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN_LEFT = re.compile(r"[A-Za-z0-9_+/-]")
_TOKEN = re.compile(r"[A-Za-z0-9_+/-]+")
_FORMATS = re.compile(r"[A-Z]{4}[A-Z0-9]{16}|[0-9a-f]{32,}|[0-9a-f]{18}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[a-z]{2,4}_[A-Za-z0-9]{20,}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_LOCAL = re.compile(r"\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}")
_TOLD = re.compile(rf"(?i)(?<![A-Za-z_])({'|'.join(sorted(TRIGGERS, key=len, reverse=True))})(?:[\x20\t]{{0,8}}([=:])[\x20\t]{{0,8}}|[\x20\t]{{1,8}})[\"']?([^\s\"'<>,;=:]{{4,}})")
_BEFORE = re.compile(r"([A-Za-z_]+)\s*([=:]?)\s*[\"']?$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for host in _EMAIL_HOST.finditer(text):
        start = at = host.start()
        while start > done and text[start - 1] in _EMAIL_NAME:
            start -= 1
        if start < at:
            yield start, host.end()
            done = host.end()


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of the base kinds, by kind and start; places count code points."""
    spans = [("email", *s) for s in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return spans
    spans += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = re.sub(r"[\x20-]", "", m[0]) if m.end() - m.start() < 64 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _shape(value: str) -> tuple[int, str, str]:
    """Changes between letters and digits, a class of the share of digits, and one of case."""
    kinds = ["d" if c in "0123456789" else "l" for c in value if c.isalnum()]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    digits = kinds.count("d") / max(len(kinds), 1)
    case = ("u" if re.search("[A-Z]", value) else "") + ("l" if re.search("[a-z]", value) else "")
    return changes, str(int(4 * digits)), case or "n"


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """``(kind, start, end, votes, features)`` of spans outside the base ones.

    A candidate is a token of nine symbols or more with a digit, or one that a word of ``TRIGGERS`` announces: with
    a sign in between (``STRONG`` ones any value, the others one with a digit) or, for ``DIRECT``, just in front of a digit's token. A vote is ``+``, ``-`` or ``0`` (none) per labeler.
    """
    spans: list[tuple[str, int, int]] = []
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        for kind, pattern in (("local_phone", _LOCAL), ("ssn", _SSN)):
            start = m.start() - (kind == "local_phone" and m.start() > done and text[m.start() - 1] == "(")
            found = pattern.match(text, start)
            if found and not text[found.end() : found.end() + 1].isalnum():
                spans.append((kind, *found.span()))
                done = found.end()
                break
        else:
            start = m.start()
            while start > done and _TOKEN_LEFT.match(text[start - 1]):
                start -= 1
            end = _TOKEN.match(text, m.start()).end()
            done = end
            if end - start >= SHORTEST:
                spans.append(("number" if text[start:end].strip("-+/_").isdigit() else "secret", start, end))
    told, at = [], 0
    for start, end in _told(text):
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        if at == len(spans) or spans[at][1] >= end:
            told.append(("told", start, end))
    taken = sorted((a, b) for _, a, b in base)
    result, i = [], 0
    for kind, start, end in sorted(spans + told, key=lambda s: s[1]):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i == len(taken) or taken[i][0] >= end:
            result.append(("secret" if kind == "told" else kind, start, end, *_judge(kind, text, start, end)))
    return result


def _told(text: str) -> Iterator[tuple[int, int]]:
    """Values announced by the gazetteer's words, by place."""
    at = 0
    while found := _TOLD.search(text, at):
        value = found[3].rstrip(".)!?")
        word = found[1].lower()
        digit = _DIGITS.search(value) is not None and (found[2] or word in DIRECT)
        if len(value) >= 4 and (digit or found[2] and word in STRONG):
            yield found.start(3), found.start(3) + len(value)
            at = found.end()
        else:
            # What was no value may itself announce one.
            at = found.start(3)


def _judge(kind: str, text: str, start: int, end: int) -> tuple[str, str]:
    value = text[start:end]
    before = _BEFORE.search(text[max(0, start - 48) : start])
    word, assigned = (before[1].lower(), bool(before[2])) if before else ("", False)
    announced = word in TRIGGERS
    changes, digits, case = _shape(value)
    format_ = {"ssn": "+", "local_phone": "+", "number": "0"}.get(kind) or ("+" if _FORMATS.fullmatch(value) else "0")
    shape = {"ssn": "0", "local_phone": "0", "number": "-"}.get(kind) or ("+" if changes >= 4 else "-" if changes < 2 and kind != "told" else "0")
    plain = kind == "number" and not _luhn(re.sub("[^0-9]", "", value))
    votes = format_ + ("+" if announced else "0") + ("+" if assigned else "0") + shape + ("-" if plain else "0")
    quoted = start > 0 and text[start - 1] in "\"'" and text[end : end + 1] in ("\"", "'")
    size = min((end - start) // 8, 6)
    return votes, f"kind={kind} size={size} digits={digits} case={case} changes={min(changes, 6)} quoted={int(quoted)} announced={int(announced)} assigned={int(assigned)}"


def reliabilities(votes: list[str], counts: list[float], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote combinations.

    Returns the probability of each combination being personal data, and per labeler and class
    (no, yes) the probabilities of voting ``-``, ``0`` and ``+``. Priors keep a labeler better than
    chance, so that the classes don't change sides.
    """
    table = np.array([["-0+".index(c) for c in v] for v in votes]).reshape(len(votes), len(LABELERS))
    weight = np.array(counts, dtype=float)
    prior = np.array([[3.0, 4.0, 1.0], [1.0, 4.0, 3.0]])
    lean = (table - 1).sum(axis=1)
    yes = 1 / (1 + np.exp(-1.5 * lean + 0.5))
    rates = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        share = (weight @ yes + 1) / (weight.sum() + 2)
        for j in range(len(LABELERS)):
            for v in range(3):
                hit = weight * (table[:, j] == v)
                rates[j, 0, v], rates[j, 1, v] = hit @ (1 - yes) + prior[0, v], hit @ yes + prior[1, v]
            rates[j] /= rates[j].sum(axis=1, keepdims=True)
        log = [np.log([1 - share, share][k]) + sum(np.log(rates[j, k, table[:, j]]) for j in range(len(LABELERS))) for k in (0, 1)]
        yes = 1 / (1 + np.exp(np.clip(log[0] - log[1], -35, 35)))
    return yes, rates


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic regression over ``name=value`` features."""

    weights: dict[str, float]
    bias: float

    def probability(self, features: str) -> float:
        total = self.bias + sum(self.weights.get(f, 0.0) for f in features.split(" "))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(votes: list[str], features: list[str], counts: list[int], rounds: int = 200, ridge: float = 1.0) -> SpanClassifier:
    """The classifier from counts of vote and feature combinations."""
    if not votes:
        return SpanClassifier({}, -1.0)
    yes, _ = reliabilities(votes, counts)
    names = sorted({f for x in features for f in x.split(" ")})
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(features), len(names) + 1))
    x[:, -1] = 1
    for row, combination in zip(x, features):
        row[[place[f] for f in combination.split(" ")]] = 1
    # Frequent combinations count with the root of their number, so that rare kinds are learned too.
    weight = np.sqrt(np.array(counts, dtype=float))
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (weight * (p - yes)) + keep * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return SpanClassifier(dict(zip(names, w[:-1].tolist())), float(w[-1]))


_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_CANDIDATE = "struct<kind:string,start:bigint,end:bigint,votes:string,features:string>"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, candidates`` for every row of ``docs``; null texts count as empty."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    candidate = pa.struct([*span, ("votes", pa.string()), ("features", pa.string())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        base, more = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            found = base_spans(text)
            base.append([dict(zip(("kind", "start", "end"), s)) for s in found])
            more.append([dict(zip(("kind", "start", "end", "votes", "features"), s)) for s in candidates(text, found)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(candidate))], ["doc_id", "base", "candidates"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint"), "text"), run, f"doc_id bigint, base array<{_SPAN}>, candidates array<{_CANDIDATE}>")


def fit(scanned: DataFrame) -> SpanClassifier:
    """The classifier from the candidates of all documents."""
    one = scanned.select(F.explode("candidates").alias("c")).groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).alias("n"))
    # Combinations of a few discrete values: a fixed number at most, however large the corpus.
    rows = sorted((r["votes"], r["features"], r["n"]) for r in one.collect())
    return train([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])


def find(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` for every row of ``docs``: spans by kind, then start.

    ``base`` has the base kinds, ``spans`` these and the classifier's. Places count code points.
    Empty and null texts have neither; ``doc_id`` is passed on, null or repeated as it may be; an
    empty table gives no rows.
    """
    scanned = materialize(scan(docs), "personal-data")
    shared = scanned.sparkSession.sparkContext.broadcast(fit(scanned))
    known: dict[str, float] = {}

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        spans = []
        for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for c in more:
                if c["features"] not in known:
                    known[c["features"]] = shared.value.probability(c["features"])
            added = [{k: c[k] for k in ("kind", "start", "end")} for c in more if known[c["features"]] >= CUT]
            spans.append(sorted([*base, *added], key=lambda s: (KINDS.index(s["kind"]), s["start"])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, batch.column(1).type)], ["doc_id", "base", "spans"])

    return map_batches(scanned, run, f"doc_id bigint, base array<{_SPAN}>, spans array<{_SPAN}>")
