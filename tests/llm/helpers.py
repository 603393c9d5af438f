"""Small document tables with the awkward cases that every operator must take."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b + c for a in ("th", "er", "an", "st", "ou") for b in ("e", "i", "o", "a") for c in ("nd", "r", "s", "ing", "ly")]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def frame(spark, texts, first=0, partitions=3):
    rows = [(first + i, t, "en", f"s{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(partitions)


def awkward(rnd: random.Random) -> list:
    """Null, empty, blank, short, repeated and very long texts."""
    same = prose(rnd, 60)
    return [None, "", "   ", "x", same, same, same, prose(rnd, 6000), "a" * 3000, "é ß 字 \U0001f600 " * 40, "\n\n\t", prose(rnd, 3)]
