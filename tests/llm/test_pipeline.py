"""The pipeline's stages against plain Python, on a small table with planted cases."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from nearkin.llm import decontamination, packing, quality_rules
from llm_helpers import documents, odd_rows, words
from test_quality_rules import plain as plain_quality
from test_similar import plain_components


def clean_text(rng, n):
    stop = quality_rules.STOP_WORDS["en"]
    return " ".join(rng.choice([rng.choice(stop), words(rng, 1)]) for _ in range(n))


def made_rows():
    rng = random.Random(7)
    rows = [(i, clean_text(rng, rng.randint(30, 300)), rng.choice("aab")) for i in range(90)]
    rows += [(200 + i, rows[i][1], "b") for i in range(10)]
    rows += [(300 + i, rows[20 + i][1] + " " + BENCHMARK[i % 3][1] + " " + words(rng, 3), "a") for i in range(6)]
    rows += [(400, "junk ### " * 40, "a"), (401, "word " * 100, "a"), (402, None, None), (403, "", "b")]
    return rows


_rng = random.Random(11)
BENCHMARK = [(i, clean_text(_rng, 30)) for i in range(3)]


def folder(spark, tmp_path, rows):
    path = str(tmp_path)
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, tmp_path):
    rows = made_rows()
    path = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "token_output":
            assert out.columns == columns
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen.append(docs.collect())
    passed, single, clean, mixed, packed = seen
    text = {d: t for d, t, _ in rows}

    left = {r["doc_id"] for r in passed}
    assert left <= {d for d, t in text.items() if not plain_quality(t)[-1]}
    assert {d for d in text if d < 390} <= left and not {400, 401, 402, 403} & left
    components = plain_components([(d, text[d], "") for d in sorted(left)])
    assert sorted(r["doc_id"] for r in single) == sorted({int(c) for _, c in components})
    items = [decontamination.normalise(t) for _, t in BENCHMARK]
    leaked = {r["doc_id"] for r in single if any(i in decontamination.normalise(r["text"]) for i in items)}
    assert leaked and {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} - leaked

    sizes = {}
    for r in clean:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    total = sum(len(r["text"].split()) for r in mixed)
    assert abs(total - 1.5 * sum(sizes.values())) < 10
    taken = {}
    for r in mixed:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + 1
    assert set(taken.values()) <= {1, 2}
    starts = [d for r in packed for d, p in zip(r["doc_ids"], r["pieces"]) if p == 0]
    assert sorted(starts) == sorted(r["doc_id"] for r in mixed)
    # Unpacking needs unique ids: documents taken once.
    once = spark.read.parquet(f"{path}/mixing").where(F.col("doc_id").isin([d for d, n in taken.items() if n == 1]))
    back = {r["doc_id"]: r["text"] for r in packing.unpack(packing.pack(once)).collect()}
    assert back == {d: text[d] for d, n in taken.items() if n == 1}


def test_run_and_odd_rows(spark, tmp_path):
    for n, rows in enumerate((made_rows(), odd_rows(), [])):
        path = folder(spark, tmp_path / str(n), rows)
        out = corpus_pipeline.run(spark, path)
        assert out.columns == re.findall(r"(\w+) (?:int|array<\w+>|binary)", packing.SCHEMA)
        # None of the odd rows is running text, so none gets through.
        assert (out.count() > 0) == (n == 0)


def test_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    assert set(entry.oracle_sql()) <= set(entry.queries())
