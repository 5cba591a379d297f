"""Registered queries of the document operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm import alignment, decontamination, merkle, mixing, packing, pii, pieces, quality_model, quality_rules, simhash, sql, substrings, toxicity, urls
from nearkin.llm.common import hash_share

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def _labels(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return _table(spark, sf, "labels").select("doc_id", F.col(column).alias("label"))


def _decided(scores: DataFrame, held_out: Column, cut: float) -> DataFrame:
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = _table(spark, sf, "documents"), hash_share(F.col("doc_id"), 4) == 2
    weights = toxicity.fit(docs, _labels(spark, sf, "toxic").where(~held_out))
    return _decided(toxicity.score(docs, weights), held_out, toxicity.CUT)


def op3_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    labels = _labels(spark, sf, "quality").withColumnRenamed("doc_id", "page_id")
    judged = urls.judge(_table(spark, sf, "pages"), labels)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    docs, held_out = _table(spark, sf, "documents"), hash_share(F.col("doc_id"), 5) == 0
    scores = quality_model.fit_and_score(docs, _labels(spark, sf, "quality").where(~held_out))
    return _decided(scores, held_out, quality_model.CUT)


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality_rules.judge(_table(spark, sf, "documents"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *base, "base_failed", "kept")


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_table(spark, sf, "documents"))


def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    picks = mixing.picks(_table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("times")).cast("bigint").alias("taken")
    return picks.select("doc_id", "size", "source_size", "target", taken)


def op8_substrings(spark: SparkSession, sf: str) -> DataFrame:
    stripped = substrings.remove_repeats(_table(spark, sf, "documents"))
    return stripped.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.find_passages(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(_table(spark, sf, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)) for k in pii.BASE_KINDS]
    counts = [(F.size(kinds) - n).cast("bigint").alias(f"n_{k}") for n, k in zip(counts, pii.BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    found = alignment.summarise(_table(spark, sf, "documents"))
    groups = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups.alias("groups_sha256"))


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    # A null id has no decimal form; its text stays as it is.
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    made = merkle.manifest(_table(spark, sf, "documents"), tampered)
    return made.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def op13_pieces(spark: SparkSession, sf: str) -> DataFrame:
    model = pieces.Pieces.read()
    decoded = pieces.decode(pieces.encode(_table(spark, sf, "documents"), model), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_url_filter": op3_url_filter,
        "op4_quality_model": op4_quality_model,
        "op5_quality_rules": op5_quality_rules,
        "op6_packing": op6_packing,
        "op7_mixing": op7_mixing,
        "op8_substrings": op8_substrings,
        "op9_decontamination": op9_decontamination,
        "op10_pii": op10_pii,
        "op11_alignment": op11_alignment,
        "op12_merkle": op12_merkle,
        "op13_pieces": op13_pieces,
    }


def oracle_sql() -> dict[str, str]:
    return sql.queries()
