"""Topic segmentation: documents cut where their vocabulary changes.

A text is a row of sentences. Words of two or more of its sentences are counted in a fixed number of
buckets; prefix sums give the counts of any run of sentences. A run costs what its words cost to
write down with their own frequencies, plus a fixed price, so a cut pays where the words on its two
sides are drawn from different vocabularies. The segmentation of least total cost is found by
dynamic programming over the sentences, each looking back over at most ``LONGEST`` of them: the time
is linear in the text. Costs are whole numbers, so every engine finds the same cuts.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.common import is_blank
from webcorpus.operators.chunks import _cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 64
LONGEST = 64  # sentences of a segment, at most
PRICE = 35.0  # of a segment, in nats; a little more than chance gains by cutting one vocabulary in two
UNIT = 1_000_000  # cost units of a nat
STEP = 2048  # sentences whose counts are held at once

WORD = re.compile(r"[^\x20\x09-\x0D.,;:!?()\"]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(sentence: str) -> list[str]:
    """Runs without blanks and common marks, A-Z in lower case."""
    return WORD.findall(sentence.translate(LOWER))


def bucket_of(word: str) -> int:
    return int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % BUCKETS


_TABLE = np.array([0, *(int(np.floor(n * np.log(n) * UNIT + 0.5)) for n in range(1, 20_000))])


def weighed(n: np.ndarray) -> np.ndarray:
    """n log n in cost units, as a whole number."""
    if n.max(initial=0) < len(_TABLE):
        return _TABLE[n]
    return np.floor(n * np.log(np.maximum(n, 1)) * UNIT + 0.5).astype(np.int64)


def sentence_counts(words: list[list[str]], known: dict[str, int]) -> np.ndarray:
    """(sentences, buckets): occurrences of words; words that are not ``known`` do not count."""
    counts = np.zeros((len(words), BUCKETS), np.int64)
    rows = [k for k, own in enumerate(words) for w in own if w in known]
    np.add.at(counts, (rows, [known[w] for own in words for w in own if w in known]), 1)
    return counts


def segment_starts(sentences: list[str], price: float = PRICE, longest: int = LONGEST) -> list[int]:
    """Where the segments of least total cost begin; of equal costs the longer last segment wins."""
    within = Counter(w for s in sentences for w in set(words_of(s)))
    known = {w: bucket_of(w) for w, n in within.items() if n > 1}
    fixed = int(np.floor(price * UNIT + 0.5))
    best, back = [0], [0]
    held = np.zeros((1, BUCKETS), np.int64)  # prefix sums before the last sentences, up to ``longest``
    for at in range(0, len(sentences), STEP):
        some = sentence_counts([words_of(s) for s in sentences[at : at + STEP]], known)
        sums = np.concatenate([held, held[-1] + np.cumsum(some, axis=0)])
        first = at + 1 - len(held)  # the sentence count that sums[0] stands for
        totals = sums.sum(axis=1)
        recent = np.array(best[first:] + [0] * len(some))
        for j in range(at + 1, at + len(some) + 1):
            low = max(0, j - longest)
            a, b = low - first, j - first
            run = sums[b] - sums[a:b]
            cost = recent[a:b] + weighed(totals[b] - totals[a:b]) - weighed(run).sum(axis=1) + fixed
            k = int(cost.argmin())
            recent[b] = cost[k]
            best.append(int(cost[k]))
            back.append(low + k)
        held = sums[-longest:] if len(sums) > longest else sums
    starts, j = [], len(sentences)
    while j > 0:
        j = back[j]
        starts.append(j)
    return starts[::-1]


def topic_starts(sentences: Column, price: float = PRICE, longest: int = LONGEST) -> Column:
    """array<int>: where segments begin in each array of sentences."""

    @F.arrow_udf("array<int>")
    def starts(column: pa.Array) -> pa.Array:
        return pa.array([segment_starts(own.as_py() or [], price, longest) for own in column], pa.list_(pa.int32()))

    return starts(sentences)


def topic_segments(docs: DataFrame, row_id: str, text: str, price: float = PRICE, longest: int = LONGEST) -> DataFrame:
    """(row_id, segment, n_sentences, text): the segments of each text in order; none for blank texts."""
    sentences = F.filter(F.split(F.col(text), r"(?<=[.!?])\s+"), lambda s: ~is_blank(s))
    rows = docs.select(row_id, sentences.alias("_s")).filter(F.size("_s") > 0)
    starts = rows.withColumn("_at", topic_starts(F.col("_s"), price, longest))
    cut = starts.select(row_id, F.posexplode(_cut(F.col("_s"), F.col("_at"))).alias("segment", "_own"))
    return cut.select(row_id, "segment", F.size("_own").alias("n_sentences"), F.array_join("_own", " ").alias("text"))
