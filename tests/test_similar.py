"""Cosine clusters against all pairs compared, and how the work grows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from webcorpus.operators import similar


def frame(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")


def units(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def exact_clusters(x, threshold):
    """The smallest index that the links of all pairs reach, by plain union."""
    u = units(x)
    label = np.arange(len(u))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for at in range(0, len(u), 1000):
        for i, j in np.argwhere(u[at : at + 1000] @ u.T >= threshold):
            a, b = root(i + at), root(j)
            label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(u))]


def groups(n, dim=32, latent=4, size=10, seed=1):
    """Near copies around places on a surface of few dimensions, as embeddings of related texts lie."""
    rng = np.random.default_rng(seed)
    surface = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:latent]
    places = rng.normal(size=(n // size, latent)) @ surface
    return units(places)[rng.integers(0, len(places), n)] + 0.0005 * rng.normal(size=(n, dim))


def scattered(n, dim=64, seed=2):
    """Random directions, each with a near copy: no pivots part these."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n // 2, dim))
    return np.concatenate([x, x + rng.uniform(0.2, 0.6, size=(n // 2, 1)) * rng.normal(size=(n // 2, dim))])


@pytest.mark.parametrize("x, threshold", [(groups(1500, latent=3), 0.999), (groups(1500, latent=3), 0.97), (scattered(1500), 0.9), (groups(1200, dim=3, latent=2), 0.9999)])
def test_small_cells_find_every_pair(spark, x, threshold):
    ones = similar.unit_vectors(frame(spark, x), "vec_id", "embedding")
    links = similar.similar_links(ones, threshold, pivots=8, leaf=60, block=100)
    found = {r.node: r.component for r in similar.connected_components(links).collect()}
    assert [found.get(i, i) for i in range(len(x))] == exact_clusters(x, threshold)


def test_each_pair_meets_where_either_is_at_home(spark):
    x = groups(800, latent=3, seed=4)
    cells = similar.metric_cells(similar.unit_vectors(frame(spark, x), "vec_id", "embedding"), 0.995, pivots=10, leaf=40, pack=64).collect()
    members, home = {}, {}
    for r in cells:
        members.setdefault(r.cell, set()).add(r.id)
        if r.home:
            assert r.id not in home
            home[r.id] = r.cell
    assert len(members) > 10 and set(home) == set(range(800))
    u = units(x)
    for i, j in np.argwhere(u @ u.T >= 0.995):
        assert i in members[home[j]] and j in members[home[i]]


def test_work_grows_slower_than_pairs(spark):
    """Comparisons with pivots and within cells, for near copies around places on a surface."""
    work = {}
    for n in (2_000, 16_000):
        ones = similar.unit_vectors(frame(spark, groups(n)), "vec_id", "embedding")
        rows = similar.metric_cells(ones, 0.9995, leaf=512).select("cell", "id", "home").collect()
        members, homes, dealt = {}, {}, set()
        for r in rows:
            members[r.cell] = members.get(r.cell, 0) + 1
            homes[r.cell] = homes.get(r.cell, 0) + r.home
            path = r.cell.split(".")
            dealt.update((".".join(path[:k]), r.id) for k in range(1, len(path)))
        work[n] = sum(m * homes[c] for c, m in members.items()) + similar.PIVOTS * len(dealt)
    power = np.log(work[16_000] / work[2_000]) / np.log(8)
    assert power < 1.6, work


def test_what_is_moved_grows_with_the_vectors(spark):
    """A cell left whole: a vector goes to as many tiles, whatever the number of vectors."""
    copies = {}
    for n in (30_000, 300_000):
        cell = spark.range(n).select(F.lit("2").alias("cell"), "id", F.array(F.lit(0.6), F.lit(0.8)).alias("v"), F.lit(True).alias("home"))
        rows = similar.tiles(cell)
        copies[n] = rows.count() / n
        largest = rows.groupBy("cell", "low", "high").count().agg(F.max("count")).first()[0]
        assert largest < 2.2 * n / copies[n]
    assert copies[30_000] == copies[300_000] == similar.PARTS
    # Wide vectors take more parts, so that two of them still fit a task.
    wide = cell.limit(500).withColumn("v", F.array_repeat(F.lit(0.1), similar.PART_BYTES // 800))
    assert similar.tiles(wide).count() == 500 * 5


def test_clusters_of_many_vectors(spark):
    x = np.concatenate([groups(30_000, dim=64, latent=5, seed=6), scattered(20_000, seed=7)])
    found = {r.vec_id: r.cluster for r in similar.cosine_dedup(frame(spark, x), "vec_id", "embedding", 0.99).collect()}
    assert [found[i] for i in range(len(x))] == exact_clusters(x, 0.99)


def test_lengths_zero_vectors_and_copies(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, []), (6, [0.0, 1.0]), (7, [1.0, 0.0]), (8, [5.0, 0.1, 0.0])]
    found = similar.cosine_dedup(spark.createDataFrame(rows, "id bigint, e array<double>"), "id", "e").collect()
    assert {r.id: (r.cluster, r.is_duplicate) for r in found} == {
        1: (1, False), 2: (1, True), 3: (3, False), 4: (4, False), 5: (5, False), 6: (6, False), 7: (1, True), 8: (3, True)
    }


@pytest.mark.parametrize("seed", range(20))
def test_labels_after_links(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 30, size=(2, rng.integers(0, 40)))
    label = similar.merged(np.arange(30), a, b)
    expected = np.arange(30)
    for _ in range(30):
        for x, y in zip(a, b):
            expected[x] = expected[y] = min(expected[x], expected[y])
    assert label.tolist() == expected.tolist()
