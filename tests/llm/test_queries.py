"""The registered queries: columns, and digests against plain Python on the given tables."""

import hashlib
import os

import pytest
import sentencepiece

from nearkin.llm import pieces, queries
from test_alignment import plain_summary
from test_models import DATA
from test_pii import plain as plain_spans
from test_quality_rules import plain as plain_quality
from test_substrings import plain as plain_repeats

SMALL = os.environ.get("NEARKIN_TESTDATA", DATA).replace("sf0.1", "sf0.001")
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id",
    "op2_toxicity": "doc_id held_out score predicted",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_quality_model": "doc_id held_out score predicted",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_mixing": "doc_id size source_size target taken",
    "op8_substrings": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op10_pii": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op11_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_pieces": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("name", COLUMNS)
def test_one_row_each(spark, name):
    found = queries.queries()[name](spark, SMALL)
    table = "pages" if "url" in name else "documents"
    assert found.columns == COLUMNS[name].split()
    rows = found.collect()
    ids = [r[0] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(found.columns[0]).collect()]
    assert sorted(r[0] for r in rows) == sorted(ids)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows if "predicted" in found.columns)


def test_pii_digest(spark, texts):
    for r in queries.op10_pii(spark, SMALL).collect():
        base = plain_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone"))


def test_repeats_digest(spark, texts):
    wanted = {d: (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()) for d, n, spans, kept in plain_repeats([(d, t, "") for d, t in texts.items()])}
    assert {r[0]: tuple(r[1:]) for r in queries.op8_substrings(spark, SMALL).collect()} == wanted


def test_quality_digest(spark, texts):
    for r in queries.op5_quality_rules(spark, SMALL).collect():
        assert tuple(r)[1:7] == plain_quality(texts[r["doc_id"]])


def test_alignment_digest(spark, texts):
    wanted = {d: (*s[:-1], hashlib.sha256(s[-1].encode()).hexdigest() if s[0] else "") for d, s in zip(texts, plain_summary(list(texts.values())))}
    assert {r[0]: tuple(r[1:]) for r in queries.op11_alignment(spark, SMALL).collect()} == wanted


def test_pieces_digest(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    for r in queries.op13_pieces(spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        sums = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids))]
        assert list(r)[1:] == [len(ids), *sums]
