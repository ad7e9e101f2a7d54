import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import ODD, corpus, prose, row, table
from webcorpus.llm import mixing


def plain_targets(sizes):
    """Sharing by weight again and again until no source is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not above:
            return {**{s: 2.0 * sizes[s] for s in full}, **share}
        full |= above


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_words(spark):
    rows = corpus(400) + ODD + [row(2000 + i, prose(i, 30), source="huge") for i in range(600)] + [row(3000, "a b c", source="tiny")]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    aims = plain_targets(dict(sizes))
    source = {str(r[0]): r[3] for r in rows}
    found = mixing.op6(table(spark, rows)).collect()
    assert Counter((str(r.doc_id), r.size) for r in found) == Counter((str(r[0]), size(r[1])) for r in rows)
    taken = Counter()
    for r in found:
        s = source[str(r.doc_id)]
        assert r.source_size == sizes[s] and abs(r.target - aims[s]) < 1e-6 * max(1, aims[s])
        assert r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        assert len(r.shards) == (r.taken // r.size if r.size else len(r.shards))
        taken[s] += r.taken
    largest = Counter()
    for r in rows:
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= largest[s] / 2 + 1


def test_reruns_and_input_order_agree(spark):
    rows = corpus(150)
    once = sorted(map(str, mixing.op6(table(spark, rows)).collect()))
    assert once == sorted(map(str, mixing.op6(table(spark, rows[::-1]).repartition(7)).collect()))


def test_large_sources_are_taken_by_blocks(spark):
    rows = [row(i, "w " * (1 + i % 7), source="ab"[i % 2]) for i in range(500)]
    found = mixing.plan(table(spark, rows), shards=8, blocks=16).collect()
    taken = Counter()
    for r in found:
        taken[r.target] += r.taken
    for target, words in taken.items():
        assert abs(words - target) <= 4


@pytest.mark.parametrize("case", [(100, 30, 50), (40, 1, 7), (9, 9, 4), (12, 0, 5), (60, 59, 30)])
def test_draws_follow_the_hypergeometric_law(spark, case):
    population, marked, drawn = (F.lit(c).cast("bigint") for c in case)
    x = mixing.hypergeometric(population, marked, drawn, (F.col("id") + 0.5) / 20_000)
    counts = Counter(r.x for r in spark.range(20_000).select(x.alias("x")).collect())
    from math import comb

    for k in range(case[2] + 1):
        p = comb(case[1], k) * comb(case[0] - case[1], case[2] - k) / comb(*case[::2]) if case[2] - k <= case[0] - case[1] else 0
        assert abs(counts[k] / 20_000 - p) < 2e-4


def test_the_tree_splits_quotas_exactly(spark):
    quotas = {1: 1000, 2: 37, 3: 0, 4: 5, 5: 200_000}
    rows = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "place int, quota bigint"), 16).collect()
    shards = Counter()
    for place, quota in quotas.items():
        own = sorted((r.shard, r.first, r.blocks) for r in rows if r.place == place)
        assert sum(b for _, _, b in own) == quota and all(b >= 0 for _, _, b in own)
        assert [f for _, f, _ in own] == [int(x) for x in np.cumsum([0, *(b for _, _, b in own)])[:-1]]
        for shard, _, b in own:
            shards[shard] += b
    assert max(shards.values()) - min(shards.values()) <= 4


def test_no_python_in_the_plan(spark):
    plan = mixing.op6(table(spark, corpus(5)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_mix_repeats_rows_as_planned(spark):
    rows = corpus(80) + ODD
    docs = table(spark, rows)
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "copy", "shard"]
    copies = Counter(str(r.doc_id) for r in mixed.collect())
    planned = Counter()
    for r in mixing.op6(docs).collect():
        planned[str(r.doc_id)] += len(r.shards)
    assert copies == +planned


def test_empty_tables_and_texts(spark):
    assert mixing.op6(table(spark, [])).collect() == []
    assert mixing.mixture(table(spark, [])).collect() == []
    found = mixing.op6(table(spark, [row(1, None), row(2, "")])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in found} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
