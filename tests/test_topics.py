"""Topic segments against every possible segmentation, and on documents joined end to end."""

import itertools
import math
import random
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from webcorpus.operators import topics
from webcorpus.operators.topics import PRICE, UNIT, bucket_of, segment_starts, words_of

SENTENCES = st.lists(st.lists(st.sampled_from("the a cat dog runs le la chat court 日 X".split()), min_size=0, max_size=8).map(" ".join), min_size=1, max_size=9)


def nlogn(n):
    return math.floor(n * math.log(n) * UNIT + 0.5) if n else 0


def total_cost(sentences, starts, price):
    words = [words_of(s) for s in sentences]
    within = Counter(w for own in words for w in set(own))
    cost = 0
    for a, b in zip(starts, [*starts[1:], len(sentences)]):
        counts = Counter(bucket_of(w) for own in words[a:b] for w in own if within[w] > 1)
        cost += nlogn(sum(counts.values())) - sum(map(nlogn, counts.values())) + math.floor(price * UNIT + 0.5)
    return cost


@settings(max_examples=150, deadline=None)
@given(SENTENCES, st.sampled_from([0.0, 0.5, 2.0, PRICE]), st.sampled_from([2, 3, 64]))
def test_no_segmentation_costs_less(sentences, price, longest):
    found = segment_starts(sentences, price, longest)
    inner = range(1, len(sentences))
    every = [[0, *c] for k in range(len(sentences)) for c in itertools.combinations(inner, k)]
    short = [s for s in every if all(b - a <= longest for a, b in zip(s, [*s[1:], len(sentences)]))]
    assert found in short
    assert total_cost(sentences, found, price) == min(total_cost(sentences, s, price) for s in short)


def test_long_texts_in_steps(monkeypatch):
    rng = random.Random(2)
    vocabularies = [["".join(rng.choice(letters) for _ in range(3)) for _ in range(12)] for letters in ("abc", "def", "ghi")]
    sentences = [" ".join(rng.choice(vocabularies[k // 40 % 3]) for _ in range(8)) for k in range(400)]
    whole = segment_starts(sentences)
    monkeypatch.setattr(topics, "STEP", 7)
    assert segment_starts(sentences) == whole == list(range(0, 400, 40))


def test_time_is_linear():
    rng = random.Random(3)
    sentences = [" ".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(20_000)]
    taken = []
    for n in (5_000, 20_000):
        start = time.process_time()
        segment_starts(sentences[:n])
        taken.append(time.process_time() - start)
    assert taken[1] < 8 * taken[0]


def pieces(text):
    return [s for s in re.split(r"(?<=[.!?])\s+", text or "") if s.strip()]


def test_seams_of_joined_documents(spark):
    """Documents of different languages joined: their seam is found within one sentence, and little else."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    usable = [(d.lang, pieces(d.text)) for d in docs if d.lang and 20 <= len(pieces(d.text)) <= 60]
    rng = random.Random(4)
    joined, seams = [], {}
    while len(joined) < 200:
        (lang, first), (other, second) = rng.sample(usable, 2)
        if lang != other:
            seams[len(joined)] = len(first)
            joined.append((len(joined), " ".join(first + second), "x"))
    rows = topics.topic_segments(spark.createDataFrame(joined, "row bigint, text string, segment string"), "row", "text").collect()
    sizes = {}
    for r in sorted(rows, key=lambda r: (r["row"], r.segment)):
        sizes.setdefault(r["row"], []).append(r.n_sentences)
    starts = {k: list(itertools.accumulate(v)) for k, v in sizes.items()}
    hits = sum(any(abs(s - seams[k]) <= 1 for s in own[:-1]) for k, own in starts.items())
    extra = sum(abs(s - seams[k]) > 1 for k, own in starts.items() for s in own[:-1])
    assert hits >= 0.9 * len(seams) and extra <= 0.5 * len(seams), (hits, extra)


def test_blank_texts_and_order(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "One. Two!  Three?"), (4, "Again.")], "row bigint, text string")
    rows = sorted(map(tuple, topics.topic_segments(docs, "row", "text").collect()))
    assert rows == [(4, 0, 1, "Again."), (4, 0, 3, "One. Two! Three?")]
