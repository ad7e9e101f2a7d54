"""Benchmark passages in documents, also with small edits, by pigeonhole and bit-parallel distance.

An item with an error budget of k is split into k + 1 pieces: a passage within k edits holds at
least one piece unchanged. Exact piece hits (one automaton for all items) propose windows; windows
that lack more of the item's 3-grams than k edits can destroy are dropped; the rest are verified
by Myers' bit-parallel edit distance. Texts are compared as lower-case words joined by one space,
so case, punctuation and line breaks cost nothing.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import plain_words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATE = 0.08  # edits allowed per character of an item
SHORTEST = 20  # items with fewer characters must be whole words, unchanged
BLOCK_ITEMS = 5_000  # items that a task holds at once
Q = 3


def distance(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Fewest edits between ``pattern`` and any part of ``text``, and the first end with that many.

    Myers' algorithm on one integer as wide as the pattern; ``most`` + 1 stands for more edits.
    """
    size = len(pattern)
    full, high = (1 << size) - 1, 1 << (size - 1)
    at: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        at[c] |= 1 << k
    plus, minus, score, best, end = full, 0, size, most + 1, 0
    for k, c in enumerate(text):
        equal = at.get(c, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(across | plus))
        down = plus & across
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up, down = up << 1, down << 1
        plus = (down | ~(vertical | up)) & full
        minus = up & vertical & full
        if score < best:
            best, end = score, k + 1
            if not best:
                break
    return best, end


class Matcher:
    """A block of items ready to be looked for."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items: list[tuple[int, str, int, frozenset[str]]] = []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            pattern = b" ".join(plain_words(text)).decode("latin-1")
            if not pattern:
                continue
            if len(pattern) < SHORTEST:
                pattern, budget = f" {pattern} ", 0
            else:
                budget = int(rate * len(pattern))
            own = len(self.items)
            grams = frozenset(pattern[k : k + Q] for k in range(len(pattern) - Q + 1))
            self.items.append((item_id, pattern, budget, grams))
            cuts = [len(pattern) * k // (budget + 1) for k in range(budget + 2)]
            for start, end in zip(cuts, cuts[1:]):
                pieces[pattern[start:end]].append((own, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, budget, word): each item found, its fewest edits and where it begins."""
        if not self.items or not text:
            return []
        plain = " " + b" ".join(plain_words(text)).decode("latin-1") + " "
        begins: dict[int, set[int]] = defaultdict(set)
        for end, (size, uses) in self.automaton.iter(plain):
            for own, offset in uses:
                begins[own].add(end + 1 - size - offset)
        found = []
        for own, starts in begins.items():
            item_id, pattern, budget, grams = self.items[own]
            best: tuple[int, int] | None = None
            for first, last in _windows(sorted(starts), len(pattern), budget):
                window = plain[max(0, first) : last]
                have = {window[k : k + Q] for k in range(len(window) - Q + 1)}
                if len(grams - have) > Q * budget:
                    continue
                edits, end = distance(pattern, window, budget)
                if edits <= budget and (best is None or edits < best[0]):
                    best = edits, max(0, max(0, first) + end - len(pattern))
            if best is not None:
                found.append((item_id, best[0], budget, plain.count(" ", 1, best[1] + 1)))
        return sorted(found)


def _windows(starts: list[int], size: int, budget: int) -> Iterator[tuple[int, int]]:
    """Parts of the text that hold a match beginning near ``starts``; overlapping ones are one."""
    first, last = starts[0] - budget, starts[0] + size + budget
    for start in starts[1:]:
        if start - budget > last:
            yield first, last
            first = start - budget
        last = start + size + budget
    yield first, last


def blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> list[DataFrame]:
    """The items in blocks of about ``size``, dealt by a hash, so that each may be held by a task."""
    items = benchmark.filter("text IS NOT NULL AND item_id IS NOT NULL").select("item_id", "text").distinct()
    count = max(1, -(-items.count() // size))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) for k in range(count)]


def passages(text: Column, block: DataFrame, rate: float = RATE) -> Column:
    """array<struct<item_id, edits, budget, word>>: the items of a block found in a text."""
    items = [(r["item_id"], r["text"]) for r in block.collect()]  # bounded: one block

    @F.arrow_udf("array<struct<item_id:bigint,edits:int,budget:int,word:int>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(items, rate)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("budget", pa.int32()), ("word", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("item_id", "edits", "budget", "word"), hit)) for hit in matcher.find(t.as_py())] for t in batch]
            yield pa.array(found, kind)

    return of(text)


def find_passages(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, budget, word) per document row and item found in it.

    ``word`` is where the passage begins, counted in words of letters and digits. Items or texts that are NULL
    or hold no word are found nowhere; of items that share an id each text is sought, and each found is a
    row; repeated document rows give repeated hits.
    """
    parts = []
    for block in blocks(benchmark):
        hits = docs.select("doc_id", passages(F.col("text"), block, rate).alias("hits"))
        parts.append(hits.select("doc_id", F.inline("hits")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, budget, word) of every benchmark item found in every whole document.

    Odd rows are as in ``find_passages``; an empty table on either side gives no rows.
    """
    return find_passages(docs, benchmark)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark passage; columns are kept.

    Every text that is not NULL counts, also one without an id.
    """
    for block in blocks(benchmark.select(F.xxhash64("text").alias("item_id"), "text")):
        docs = docs.filter(F.size(passages(F.col("text"), block)) == 0)
    return docs
