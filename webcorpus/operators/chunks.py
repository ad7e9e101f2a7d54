"""Chunking of documents. A document is one row, so chunks are cut inside the row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.common import is_blank, let, trim_space
from webcorpus.functions.text import heading_line

MIN_OVERLAP = 0.05
MAX_CHARS = 1000


def _cut(items: Column, starts: Column) -> Column:
    """Slices of ``items`` that begin at the 0-based ``starts``."""
    return let(
        starts,
        lambda s: F.transform(
            s,
            lambda start, i: F.slice(
                items, start + 1, F.coalesce(F.get(s, i + 1), F.size(items)) - start
            ),
        ),
    )


def _positions(items: Column) -> Column:
    return F.sequence(F.lit(0), F.size(items) - 1)


def topic_chunks(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, chunk, text): sections that end at blank lines and begin at headings."""

    def opens(line: Column) -> Column:
        return is_blank(line) | heading_line(trim_space(line))

    def sections(lines: Column) -> Column:
        starts = F.filter(_positions(lines), lambda i: (i == 0) | opens(F.get(lines, i)))
        joined = F.transform(
            _cut(lines, starts), lambda s: F.array_join(F.filter(s, lambda x: ~is_blank(x)), "\n")
        )
        return F.filter(joined, lambda s: s != "")

    chunks = let(F.split(F.col(text), "\n"), sections)
    return docs.select(row_id, F.posexplode(chunks).alias("chunk", "text"))


def semantic_chunks(
    docs: DataFrame,
    row_id: str,
    text: str,
    min_overlap: float = MIN_OVERLAP,
    max_chars: int = MAX_CHARS,
) -> DataFrame:
    """(row_id, chunk, n_sentences, text): runs of sentences that share words.

    A chunk ends where neighbouring sentences have a token Jaccard below ``min_overlap`` or
    where the next sentence would take it past ``max_chars`` characters.
    """

    def run(sentences: Column) -> Column:
        tokens = F.transform(
            sentences,
            lambda s: F.array_distinct(F.split(F.lower(trim_space(s)), " ")),
        )

        def apart(t: Column, i: Column) -> Column:
            other = F.get(t, i - 1)
            mine = F.get(t, i)
            shared = F.size(F.array_intersect(other, mine))
            return shared < F.lit(min_overlap) * (F.size(other) + F.size(mine) - shared)

        def steps(t: Column) -> Column:
            return F.transform(
                sentences,
                lambda s, i: F.struct(
                    i.alias("i"),
                    F.length(s).alias("n"),
                    F.when(i > 0, apart(t, i)).otherwise(True).alias("apart"),
                ),
            )

        def fold(acc: Column, s: Column) -> Column:
            cut = s["apart"] | (acc["n"] + s["n"] > max_chars)
            return F.struct(
                F.when(cut, F.concat(acc["starts"], F.array(s["i"])))
                .otherwise(acc["starts"])
                .alias("starts"),
                F.when(cut, s["n"]).otherwise(acc["n"] + s["n"]).alias("n"),
            )

        zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("n"))
        starts = F.aggregate(let(tokens, steps), zero, fold)["starts"]
        return F.transform(
            _cut(sentences, starts),
            lambda c: F.struct(F.size(c).alias("n_sentences"), F.array_join(c, " ").alias("text")),
        )

    sentences = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: ~is_blank(s))
    chunks = let(sentences, lambda s: F.when(F.size(s) > 0, run(s)))
    rows = docs.select(row_id, F.posexplode(chunks).alias("chunk", "c"))
    return rows.select(row_id, "chunk", "c.n_sentences", "c.text")
