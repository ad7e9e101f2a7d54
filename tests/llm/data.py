"""Small document tables with the odd cases every operator has to stand."""

from __future__ import annotations

import random
import zlib

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, key string, size int"


def remainder(doc_id, modulus):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % modulus


def row(doc_id, text, lang="en", source="s0"):
    """A document with extra columns that operators also use as names."""
    return (doc_id, text, lang, source, None if text is None else len(text), 7.0, "k", 3)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ODD = [
    row(9001, None, None, None),
    row(9002, "", None, ""),
    row(9003, " \t\n ", "en", None),
    row(9004, "12345 !!! ???", "en", "s1"),
    row(None, "a text without an id", "en", "s1"),
    row(9005, "same row twice", "en", "s2"),
    row(9005, "same row twice", "en", "s2"),
    row(9006, "long " * 30_000, "en", "s2"),
    row(9007, "one", None, "s3"),
    row(9008, "Grüße 😀 \x00 ﬁn", "de", "é"),
]

VOWELS = {"en": "ea", "de": "eü", "fr": "éo", "es": "ao"}


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = random.Random(f"{seed}{lang}")
    letters = {"en": "thngs", "de": "schtz", "fr": "lqrmx", "es": "ñcdrl"}[lang]
    words = ["".join(rng.choice(letters) + rng.choice(VOWELS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words) + "."


def corpus(n: int = 120) -> list[tuple]:
    langs = list(VOWELS)
    return [row(i, prose(i, 20 + i % 50, langs[i % 4]), langs[i % 4], f"s{i % 5}") for i in range(n)]
