import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import ODD, corpus, row, table
from webcorpus.llm import simhash


def brute_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    label = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= radius:
                    label[i] = label[j] = min(label[i], label[j])
    return label


def near_rows():
    rows = corpus(60)
    return rows + ODD + [row(500 + k, rows[k][1] + " extra", "en") for k in range(8)] + [row(700, rows[3][1].upper())]


def test_groups_match_brute_force(spark):
    rows = near_rows()
    found = simhash.op9(table(spark, rows)).collect()
    assert len(found) == len(rows)
    fps = [brute_fingerprint(r[1]) for r in rows]
    label = brute_components(fps)
    low = {}
    for r, c in zip(rows, label):
        if r[0] is not None:
            low[c] = min(low.get(c, r[0]), r[0])
    expected = sorted(((r[0] if r[0] is not None else -1), f"{f:016x}", low.get(c, -1)) for r, f, c in zip(rows, fps, label))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in found)
    assert got == expected


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    kept = simhash.keep_one(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    groups = {(r.component_id, r.fingerprint if r.component_id is None else 0) for r in simhash.op9(table(spark, rows)).collect()}
    assert len(ids) == len(groups)
    assert ids.count(9005) == 1


def test_empty_table(spark):
    empty = table(spark, [])
    assert simhash.op9(empty).collect() == []
    assert simhash.keep_one(empty).collect() == []


fingerprints = st.lists(
    st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 63).map(lambda b: 1 << b), st.integers(0, 300)), min_size=1, max_size=60, unique=True
)


@settings(max_examples=60, deadline=None)
@given(fingerprints, fingerprints)
def test_tiles_link_what_all_pairs_link(left, right):
    """Chunks of any two cells, skipping by counts, against comparing all."""
    a, b = np.array(left, np.uint64).view(np.int64), np.array(right, np.uint64).view(np.int64)
    every = left + right
    edges = simhash.link_cells(a, b, 0, 4)
    parent = {x: x for x in every}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in edges:
        x, y = top(x % 2**64), top(y % 2**64)
        parent[max(x, y)] = min(x, y)
    for x in left:
        for y in right:
            assert (top(x) == top(y)) or (x ^ y).bit_count() > 4
    # Nothing is linked but through links of the two sides.
    label = {x: x for x in every}
    for _ in every:
        for x in left:
            for y in right:
                if (x ^ y).bit_count() <= 4:
                    label[x] = label[y] = min(label[x], label[y])
    assert len({top(x) for x in every}) == len(set(label.values()))


@pytest.mark.parametrize("chunk", [1, 3])
def test_small_chunks_change_nothing(spark, chunk):
    rows = near_rows()
    fps = sorted({brute_fingerprint(r[1]) for r in rows})
    table_ = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp bigint")
    whole = {(r.node, r.component) for r in simhash.components(simhash.links(table_)).collect()}
    parts = {(r.node, r.component) for r in simhash.components(simhash.links(table_, chunk=chunk)).collect()}
    assert whole == parts and whole


def test_a_large_group_of_near_copies_gives_few_rows(spark):
    table_ = spark.createDataFrame([((1 << a) | (1 << b) | (1 << c),) for a in range(20) for b in range(a) for c in range(b)], "fp bigint")
    n = table_.count()
    links = simhash.links(table_)
    assert links.count() < 60 * n
    assert simhash.components(links).select("component").distinct().count() == 1
