"""Small tables for the document operators."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that operators use inside or return.
CLASHES = (
    "fp", "doc", "size", "start", "end", "bucket", "content", "label", "kept", "score", "source_size", "target", "times", "row_hash",
    "n_words", "base", "spans", "stats", "shard", "row", "_words", "_row", "_doc", "_kept", "_times", "_hash", "_n", "_id", "host", "path",
)


def documents(spark, rows, clashes=False):
    """A documents table from ``(doc_id, text, source)``."""
    made = [(d, t, "en", s, None if t is None else len(t)) for d, t, s in rows]
    table = spark.createDataFrame(made, SCHEMA).repartition(3)
    if clashes:
        from pyspark.sql import functions as F

        table = table.select("*", *[F.lit("extra").alias(c) for c in CLASHES])
    return table


def words(rng: random.Random, n: int, letters: str = "abcdefghé") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


def odd_rows(seed: int = 1):
    """Nulls, empty, blank, short, long and repeated rows."""
    rng = random.Random(seed)
    long = words(rng, 30_000)
    return [
        (1, words(rng, 60), "a"), (2, None, "a"), (3, "", "b"), (4, " \t\n\x0b\x0c\r ", "b"), (5, "one", None), (None, words(rng, 20), "a"),
        (6, long, "c"), (7, long, "c"), (8, "x" * 50_000, "c"), (1, words(random.Random(9), 60), "a"), (9, "same row " * 15, "d"),
        (9, "same row " * 15, "d"), (9, "same row " * 15, "d"), (10, "naïve café ✓ 😀 " * 9, None), (None, None, None), (11, "a,b;c#d&e|f<g>" * 12, "d"),
    ]
