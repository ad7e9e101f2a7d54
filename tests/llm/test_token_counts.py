import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webcorpus.llm import token_counts
from webcorpus.llm.token_counts import PrefixCounter, vocabulary_path

from .data import ODD, corpus, row, table

PATH = vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as file:
        return PrefixCounter(file.read())


def encoded(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


HARD = [
    "Don't we're they'll I'd it's o'clock 'tis ''s !'re 've",
    "a  b   c\n\nd \n e\t\tf   ",
    "   lead  x  y\r\n\r\nz",
    "x <|endoftext|> y<|endoftext|><|endoftext|>z <|endoftext",
    "<|endoftext|>",
    "!!<|endoftext|>!!  <|endoftext|>  ",
    "Grüße 😀😀 ﬁn naïve café — “quoted” ½ ² 日本語テキスト русский текст",
    "՘֋\U0001fae8\U0001fae8  \U0001fae8 new 🤔 characters ౜",  # unknown to older Unicode
    "\x00\x01\x1c\x1d \x85 ᠎ ﻿",
    "=" * 70 + " " * 90 + "-" * 33 + "x" * 50 + "aaaa" * 30,
    "éé ‍‍ zero​width",
    "12345678901234567890 3.14159 0x1F",
]


@pytest.mark.parametrize("text", HARD)
def test_every_prefix_is_counted_as_the_library_does(library, counter, text):
    counts = counter.counts(text)
    assert counts.tolist() == [encoded(library, text[:k]) for k in range(1, len(text) + 1)]


def test_random_texts_at_every_prefix(library, counter):
    rng = random.Random(5)
    alphabet = ["'", "s", "r", "e", "l", " ", " ", "\n", "a", "th", "ing", "é", "ß", "日", "😀", "1", "23", "!", "<|endoftext|>", "<|end", "\t", "ՙ՘"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
        expected = [encoded(library, text[:k]) for k in range(1, len(text) + 1)]
        assert counter.counts(text).tolist() == expected, text


def test_every_character_is_split_as_in_the_library(library, counter):
    text = "".join(f"a{chr(c)} {chr(c)}1" for c in range(0x3000) if c != 0x27) + "".join(chr(c) for c in range(0x10000, 0x11000))
    assert counter.pieces(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
    assert counter.counts(text)[-1] == encoded(library, text)


def test_long_single_piece_is_linear(library, counter):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij") for _ in range(200_000))
    assert counter.counts(text)[-1] == encoded(library, text)
    assert text not in counter.tables  # long pieces are not remembered


def test_memory_starts_anew(library, monkeypatch, counter):
    monkeypatch.setattr(token_counts, "PIECES", 3)
    monkeypatch.setattr(token_counts, "PAIRS", 3)
    counter.tables.clear()
    counter.fits.clear()
    for text in HARD[:4]:
        assert counter.counts(text)[-1] == encoded(library, text)
    assert len(counter.tables) <= 3 and len(counter.fits) <= 3


def test_neighbours_suit_as_plain_merging_says(counter):
    rng = random.Random(3)
    tokens = sorted(counter.parts)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(20_000)]
    pairs += [(t[:k], t[k:]) for t in rng.sample(tokens, 3000) for k in range(1, len(t)) if t[:k] in counter.parts and t[k:] in counter.parts]
    pairs += [("a" * i, "a" * j) for i in (1, 2, 4, 8) for j in (1, 2, 4, 8)] + [(" " * i, " " * j) for i in range(1, 9) for j in range(1, 9)]
    for a, b in pairs:
        if counter.merged(a) == [a] and counter.merged(b) == [b]:
            assert counter.suits(a, b) == (counter.merged(a + b) == [a, b]), (a, b)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        PrefixCounter('{"model": {"type": "WordPiece"}}')


def test_query_against_the_library(spark, sf, library):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in token_counts.op12(docs).collect()}
    for r in docs.collect():
        text = r.text or ""
        got = found[r.doc_id]
        assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(text.encode()), encoded(library, text), encoded(library, text) > 1024)
        within = text[: got.limit_chars]
        assert encoded(library, within) <= 1024 and (got.limit_chars == len(text) or encoded(library, text[: got.limit_chars + 1]) > 1024)


def test_odd_rows_and_clashing_names(spark, library):
    rows = ODD + [row(1, t) for t in HARD] + corpus(8)
    docs = table(spark, rows).withColumn("n_tokens", F.lit("clash")).withColumn("_x", F.lit(1))
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in token_counts.op12(docs).collect())
    assert found == sorted((r[0] or -1, len((r[1] or "").encode()), encoded(library, r[1] or "")) for r in rows)
    counted = token_counts.count_tokens(docs)
    assert counted.columns.count("n_tokens") == 1 and counted.count() == len(rows)
    assert token_counts.op12(table(spark, [])).collect() == []


def test_stored_counts_answer_cuts_and_budgets(spark, library):
    texts = [t for t in HARD if t] + ["", None]
    docs = table(spark, [row(i, t) for i, t in enumerate(texts)])
    counts = F.col("prefix_tokens")
    asked = token_counts.prefix_counts(docs).select(
        "doc_id",
        token_counts.tokens_before(counts, F.lit(7)).alias("seven"),
        token_counts.tokens_before(counts, F.lit(10_000)).alias("all"),
        token_counts.tokens_before(counts, F.lit(0)).alias("none"),
        token_counts.longest_within(counts, F.lit(5)).alias("five"),
    )
    for r in asked.collect():
        text = texts[r.doc_id] or ""
        sizes = [encoded(library, text[:k]) for k in range(len(text) + 1)]
        assert (r.seven, r.all, r.none) == (sizes[min(7, len(text))], sizes[-1], 0)
        assert r.five == max(k for k, s in enumerate(sizes) if s <= 5)


def test_counts_are_small_integers(counter):
    assert counter.counts("some words").dtype == np.int32
