"""Cross-tokenizer alignment against token-by-token comparison with the libraries' own encodings."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from llm_helpers import SCHEMA, documents, odd_rows, words
from nearkin.llm import alignment
from test_pieces import PARTS


@pytest.fixture(scope="module")
def tables():
    return alignment.Tokenizers.read()


def encodings():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.MODEL_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.MODEL_B))


def plain(texts):
    """Per text: ids of A, ids of B, links as places, cuts; None without tokens."""
    a, b = encodings()
    symbols, found = alignment.byte_symbols(), []
    for text in texts:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(symbols[s] for s in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[1:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            found.append(None)
            continue
        ranges = []
        for tokens in (bytes_a, bytes_b):
            ends = np.cumsum([len(t) for t in tokens]).tolist()
            ranges.append(list(zip([0, *ends], ends)))
        links, first = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            while ranges[1][first][1] <= s:
                first += 1
            j = first
            while j < len(ids_b) and ranges[1][j][0] < e:
                links.append((i, j))
                j += 1
        cuts = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        groups, at_a, at_b = [], 0, 0
        for cut in cuts:
            to_a = next(i for i in range(at_a, len(ids_a)) if ranges[0][i][1] == cut) + 1
            to_b = next(i for i in range(at_b, len(ids_b)) if ranges[1][i][1] == cut) + 1
            groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
            at_a, at_b = to_a, to_b
        found.append((ids_a, ids_b, links, cuts, ";".join(groups)))
    return found


def plain_summary(texts):
    aligned = plain(texts)
    counts, highest = Counter(), Counter()
    for a, b, links, *_ in filter(None, aligned):
        counts.update({(a[i], b[j]) for i, j in links})
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    rows = []
    for found in aligned:
        if found is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links, cuts, groups = found
        pairs = [(a[i], b[j]) for i, j in links]
        rows.append((len(a), len(b), len(cuts), len(links), sum(counts[p] == highest[p[0]] for p in pairs), sum(counts[p] for p in pairs), groups))
    return rows


def test_merges_make_the_ids(tables):
    """Merging by least id of the result, as ``Tokenizers`` does, ends every token with the merge the file lists."""
    with open(public_tokenizers.path(alignment.MODEL_A), encoding="utf-8") as file:
        merges = json.load(file)["model"]["merges"]
    symbols = alignment.byte_symbols()
    ids = {t: i for i, t in enumerate(tables.a_bytes) if i not in tables.a_special}
    for merge in merges:
        left, right = (bytes(symbols[s] for s in part) for part in (merge.split(" ") if isinstance(merge, str) else merge))
        parts = [bytes([x]) for x in left + right]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: ids.get(parts[i] + parts[i + 1], 1 << 30))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        assert parts == [left, right]


@pytest.mark.parametrize("lane", [1, 2, 7, 256])
def test_lockstep(lane):
    rng = np.random.default_rng(lane)
    sizes_a, sizes_b, starts = [], [], []
    for total in [1, 5, 300, 0, 2000]:
        if total:
            starts.append(len(sizes_a))
        for sizes in (sizes_a, sizes_b):
            ends = np.append(rng.choice(np.arange(1, total), max(0, total // 3), replace=False), total) if total > 1 else np.array([total])
            sizes.extend(s for s in np.diff(np.sort(ends), prepend=0).tolist() if s)
    a, b, cut = alignment.lockstep(np.array(sizes_a), np.array(sizes_b), np.array(starts), lane)
    ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
    wanted = [(i, j) for i in range(len(ends_a)) for j in range(len(ends_b)) if ends_a[i] - sizes_a[i] < ends_b[j] and ends_b[j] - sizes_b[j] < ends_a[i]]
    assert list(zip(a.tolist(), b.tolist())) == wanted
    assert cut.tolist() == [bool(ends_a[i] == ends_b[j]) for i, j in wanted]


def made_rows():
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))), "s") for i in range(60)]
    rows += [(100 + i, words(rng, rng.randint(1, 300)), "s") for i in range(40)]
    return [*rows, (200, "a ▁ b", "s"), (201, "<|endoftext|> x", "s"), (202, words(rng, 20_000), "s"), *odd_rows()]


@pytest.mark.parametrize("clashes", [False, True])
def test_summaries(spark, clashes):
    rows = made_rows()
    found = alignment.summarise(documents(spark, rows, clashes), block_bytes=20_000)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    wanted = [(d, *s) for (d, _, _), s in zip(rows, plain_summary([t for _, t, _ in rows]))]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_links(spark):
    rows = [(n, text, source) for n, (_, text, source) in enumerate(made_rows())]
    found = {r["doc_id"]: r for r in alignment.links(alignment.tokenize(documents(spark, rows))).collect()}
    for (d, _, _), wanted in zip(rows, plain([t for _, t, _ in rows])):
        a, b, links, cuts, _ = wanted or ([], [], [], [], "")
        assert (found[d]["a"], found[d]["b"], found[d]["cuts"]) == (a, b, cuts)
        assert list(zip(found[d]["link_a"], found[d]["link_b"])) == links


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert alignment.summarise(empty).collect() == []
    assert alignment.links(alignment.tokenize(empty)).collect() == []
    none = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None)], SCHEMA)
    assert sorted(map(tuple, alignment.summarise(none).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
