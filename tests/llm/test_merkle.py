"""Hash trees against plain Python, with bundles small enough that trees take several of them."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from llm_helpers import SCHEMA, documents, odd_rows
from nearkin.llm import merkle, queries, sql


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(hashes):
    """Root, and for each leaf its siblings by level."""
    paths, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for leaf, p in enumerate(at):
            run = hashes[p // 3 * 3 : p // 3 * 3 + 3]
            paths[leaf].append((run[: p % 3], run[p % 3 + 1 :]))
            at[leaf] = p // 3
        hashes = [h(*hashes[i : i + 3]) for i in range(0, len(hashes), 3)]
    return hashes[0], paths


def plain(rows, tamper):
    """``rows`` are ``(doc_id, text, lang, source, n_chars)``."""
    by_source = {}
    for d, text, lang, source, n in rows:
        leaf, found = (h(*map(field, (d, source, lang, n, t))) for t in (text, tamper(d, text)))
        by_source.setdefault(source, []).append((d is not None, d or 0, leaf, d, found))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by_source[s])]) for s in sources}
    root, above = plain_tree([trees[s][0] for s in sources]) if sources else ("", [])
    result = []
    for s, up in zip(sources, above):
        for (_, _, leaf, d, found), path in zip(sorted(by_source[s]), trees[s][1]):
            for left, right in path + up:
                found = h(*left, found, *right)
            proof = h(*[x for left, right in path + up for x in (*left, *right)])
            result.append((d, leaf, trees[s][0], root, proof, found, found == root))
    return sorted(map(repr, result))


def in_order(frame):
    return sorted(repr(tuple(r)) for r in frame.select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified").collect())


def remove_newlines(d, text):
    return text.replace("\n", "") if text is not None and d is not None and d % 2 else text


def without_newlines():
    return F.when(F.col("doc_id") % 2 != 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def made_rows(sizes):
    return [
        (1000 * s + i, None if i % 11 == 3 else f"text {i}\n" * (i % 4), "en", source, i if i % 7 else None)
        for s, (source, size) in enumerate(sizes)
        for i in range(size)
    ]


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_trees(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "WIDTH", 3**levels)
    sizes = [(None, 3), ("", 1), ("a", 2), ("b", 4), ("ä", 9), ("c", 10), ("d", 27), ("e", 29), ("z", 100), ("😀", 1), ("�", 2)]
    rows = made_rows(sizes)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert in_order(merkle.manifest(docs, without_newlines())) == plain(rows, remove_newlines)


def test_one_bundle_and_more(spark):
    rows = made_rows([("a", 2187), ("b", 2188), ("c", 1)])
    rows = [(d + 3000 * (s == "b") + 9000 * (s == "c"), t, lang, s, n) for d, t, lang, s, n in rows]
    assert in_order(merkle.manifest(spark.createDataFrame(rows, SCHEMA).repartition(4), without_newlines())) == plain(rows, remove_newlines)


@pytest.mark.parametrize("clashes", [False, True])
def test_odd_rows(spark, clashes):
    rows = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in odd_rows()]
    found = merkle.manifest(documents(spark, odd_rows(), clashes).withColumn("tree", F.lit("x")).withColumn("hash", F.lit("x")))
    assert in_order(found) == plain(rows, lambda d, t: t)
    assert found.where("not verified").count() == 0


def test_single_and_empty(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(7, "x\ny", "en", None, 3)]
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), without_newlines())
    assert in_order(found) == plain(rows, remove_newlines)
    row = found.first()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == [] and not row["verified"]


def test_query_and_sql(spark, tmp_path):
    rows = made_rows([(None, 5), ("s1", 1), ("s2", 40), ("s10", 13)])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    tamper = lambda d, t: t.replace("\n", "") if t is not None and zlib.crc32(str(d).encode()) % 2 == 0 else t
    found = queries.op12_merkle(spark, str(tmp_path))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(repr(tuple(r)) for r in found.collect())
    assert got == plain(rows, tamper)
    tables = duckdb.connect()
    tables.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(repr, tables.sql(sql.merkle()).fetchall())) == got
