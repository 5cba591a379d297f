"""Toxicity and quality: held-out accuracy, and odd rows."""

import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from nearkin.llm import quality_model, toxicity
from nearkin.llm.common import hash_share
from llm_helpers import documents, odd_rows

DATA = "/root/testdata/sf0.1"


def tables(spark):
    folder = os.environ.get("NEARKIN_TESTDATA", DATA)
    return spark.read.parquet(f"{folder}/documents.parquet").repartition(8), spark.read.parquet(f"{folder}/labels.parquet")


def rates(scores, labels, column, cut):
    rows = scores.join(labels, "doc_id").select(F.col(column).alias("y"), (F.col("score") >= cut).cast("int").alias("p")).collect()
    share = lambda y: np.mean([r["p"] for r in rows if r["y"] == y])
    return share(1), share(0)


def test_crc_share(spark):
    rows = spark.range(50).select("id", hash_share(F.col("id"), 4).alias("part")).collect()
    assert all(r["part"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in rows)


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    held = hash_share(F.col("doc_id"), 4) == 2
    weights = toxicity.fit(docs, labels.where(~held).select("doc_id", F.col("toxic").alias("label")))
    found, false = rates(toxicity.score(docs.where(held), weights), labels, "toxic", toxicity.CUT)
    # About one label in eight of the toxic ones is noise.
    assert found > 0.8 and false < 0.02
    assert 0 < len(weights.ids) < 20_000


def test_toxicity_odd_rows(spark):
    docs = documents(spark, odd_rows(), clashes=True)
    none = spark.createDataFrame([], "doc_id bigint, label int")
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (5, None), (77, 1)], "doc_id bigint, label int")
    for labels in (none, some):
        scored = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.score(documents(spark, []), toxicity.fit(documents(spark, []), none)).count() == 0


def test_features_do_not_depend_on_spans(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "_SPAN", 50)
    assert (toxicity.features(text) == whole).all()


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    held = hash_share(F.col("doc_id"), 5) == 0
    scores = quality_model.fit_and_score(docs, labels.where(~held).select("doc_id", F.col("quality").alias("label")))
    good, bad = rates(scores.where(held), labels, "quality", quality_model.CUT)
    assert good > 0.98 and bad < 0.05


def test_quality_odd_rows(spark):
    docs = documents(spark, odd_rows(), clashes=True)
    for made in ([], [(1, 1), (1, 0), (2, 0), (None, 1), (5, None), (77, 1)], [(1, 1)]):
        labels = spark.createDataFrame(made, "doc_id bigint, label int")
        scored = quality_model.fit_and_score(docs, labels).collect()
        assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_model.fit_and_score(documents(spark, []), labels).count() == 0


def test_discriminant_is_the_density_difference():
    rng = np.random.default_rng(1)
    x = [rng.normal(0, 1, (400, 3)), rng.normal(1, [1, 2, 0.5], (300, 3))]
    model = quality_model.discriminant(
        np.array([400.0, 300.0]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x]), shrink=0.0, diagonal=0.0
    )
    points = rng.normal(0, 2, (20, 3))
    log = []
    for a in x:
        cov = np.cov(a.T) + 1e-6 * np.diag(np.diag(np.cov(np.concatenate([b - b.mean(axis=0) for b in x]).T)))
        d = points - a.mean(axis=0)
        log.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    assert np.allclose(model.scores(points), 1 / (1 + np.exp(-(log[1] - log[0] + np.log(301 / 401)))), atol=1e-3)
