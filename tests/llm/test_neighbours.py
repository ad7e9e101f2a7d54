import numpy as np
import pytest

from webcorpus.llm import neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score int")


def exact(rows, k=20):
    """Every query's nearest rows, all compared."""
    sound = {}
    for vec_id, v, *_ in rows:
        if vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        sound[vec_id, tuple(np.float32(x) for x in v)] = np.array(v, np.float32).astype(np.float64)
    found = {}
    for (q, _), x in sound.items():
        if q % 20 == 0:
            near = [(-float(y @ x), c) for (c, _), y in sound.items() if c != q and len(y) == len(x)]
            found.setdefault(q, []).extend(near)
    return {q: [(c, -s) for s, c in sorted(near)[:k]] for q, near in found.items()}


def got(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, truth):
    return np.mean([len({c for c, _ in found.get(q, [])} & {c for c, _ in near}) / max(1, len(near)) for q, near in truth.items()])


def random_rows(n, dim, seed, scale=True):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if scale:  # lengths differ, so the largest product is not the smallest angle
        x *= rng.uniform(0.2, 3, size=(n, 1))
    return [(i, [float(v) for v in row], 0, 1) for i, row in enumerate(x.astype(np.float32))]


def shaped(kind, n, dim=64, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if kind == "lengths":
        x *= rng.uniform(0.2, 3, size=(n, 1))
    if kind == "clusters":
        x = rng.normal(size=(40, dim))[rng.integers(0, 40, n)] + 0.3 * x
    return x.astype(np.float32)


@pytest.mark.parametrize("kind, n", [("normal", 8_000), ("lengths", 8_000), ("clusters", 8_000), ("normal", 24_000)])
def test_recall_in_production(spark, kind, n):
    """The query itself, at its own shard size and beam, on directions without any structure and with some."""
    x = shaped(kind, n)
    table = vectors(spark, [(i, v, 0, 1) for i, v in enumerate(x.tolist())])
    found = got(neighbours.op3(table).collect())
    x = x.astype(np.float64)
    shares = []
    for q in range(0, n, 20):
        products = x @ x[q]
        products[q] = -np.inf
        near = np.lexsort((np.arange(n), -products))[:20]
        shares.append(len(set(near.tolist()) & {c for c, _ in found[q]}) / 20)
    assert np.mean(shares) >= 0.95 and min(shares) >= 0.5


def test_beam_widens_until_it_finds_enough():
    points = neighbours._extended(shaped("normal", 600), 1e9)
    asks = neighbours._directions(shaped("normal", 30, seed=2).astype(float))
    graph = neighbours.build(points)
    width = neighbours.fitting_beam(points, graph, asks, 21, 24)
    found, _ = neighbours.beam_search(points, graph, asks, 600, width, products=True)
    best = np.argsort(-(asks @ points.T), axis=1)[:, :21]
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(best.tolist(), found.tolist())]) >= 0.97
    # A graph without edges finds nothing, so all points are taken.
    assert neighbours.fitting_beam(points, np.full_like(graph, -1), asks, 21, 24) == 600


def test_recall_over_several_shards(spark):
    rows = random_rows(3000, 24, 1)
    found = got(neighbours.nearest(vectors(spark, rows), "vec_id % 20 = 0", shard_rows=700, block_rows=40).collect())
    truth = exact(rows)
    assert set(found) == set(truth) and all(len(f) == 20 for f in found.values())
    assert recall(found, truth) >= 0.95
    points = {r[0]: np.array(r[1], np.float32).astype(np.float64) for r in rows}
    for q, near in found.items():
        assert all(abs(s - points[c] @ points[q]) < 1e-9 for c, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_recall_with_lengths_over_many_powers_of_ten(spark):
    rows = random_rows(2500, 24, 6)
    # A few vectors are far longer or shorter than the rest, among them a query of either kind.
    scaled = {**{7 + 300 * k: 1e5 for k in range(8)}, 20: 1e5, 40: 1e-6, 33: 1e-6, 34: 1e18}
    rows = [(i, [float(np.float32(x * scaled.get(i, 1.0))) for x in v], *rest) for i, v, *rest in rows]
    found = got(neighbours.nearest(vectors(spark, rows), "vec_id % 20 = 0", shard_rows=900, block_rows=60).collect())
    truth = exact(rows)
    assert set(found) == set(truth) and recall(found, truth) >= 0.95


def test_recall_on_the_given_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert recall(got(neighbours.op3(table).collect()), exact(rows)) >= 0.95


def test_copies_ties_and_unsound_vectors(spark):
    rows = random_rows(60, 4, 2)
    rows += [(100 + i, [1.0, 0.0, 0.0, 0.0], 0, 1) for i in range(200)]  # one vector holds most rows
    rows += [(100, [1.0, 0.0, 0.0, 0.0], 0, 1)]  # a repeated row
    rows += [(1000, None, 0, 1), (1020, [0.0] * 4, 0, 1), (1040, [1.0, None, 2.0, 3.0], 0, 1), (1060, [1.0, float("nan"), 0.0, 0.0], 0, 1)]
    rows += [(1080, [float("inf"), 0.0, 0.0, 0.0], 0, 1), (None, [1.0, 1.0, 1.0, 1.0], 0, 1), (1100, [2.0, 1.0], 0, 1), (1101, [1.0, 1.0], 0, 1)]
    found = got(neighbours.op3(vectors(spark, rows)).collect())
    truth = exact(rows)
    assert {q: [c for c, _ in near] for q, near in found.items()} == {q: [c for c, _ in near] for q, near in truth.items() if near}


def test_few_or_no_candidates(spark):
    assert neighbours.op3(vectors(spark, [])).collect() == []
    assert neighbours.op3(vectors(spark, [(0, [1.0, 2.0], 0, 1)])).collect() == []
    few = neighbours.op3(vectors(spark, [(0, [1.0, 2.0], 0, 1), (3, [0.5, 1.0], 0, 1)])).collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in few] == [(0, 1, 3, 2.5)]
    assert neighbours.op3(vectors(spark, [(1, [1.0, 2.0], 0, 1), (3, [0.5, 1.0], 0, 1)])).collect() == []


def test_pruning_keeps_diverse_edges():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(50, 6)).astype(np.float32)
    found = np.tile(np.arange(50), (50, 1))
    kept = neighbours.prune(points, np.arange(50), found, 10, 1.2)
    gaps = ((points[:, None] - points[None]) ** 2).sum(-1)
    for node, edges in enumerate(kept):
        edges = edges[edges >= 0]
        expected = []
        for c in np.argsort(gaps[node], kind="stable"):
            if c != node and all(1.44 * gaps[e, c] > gaps[node, c] for e in expected) and len(expected) < 10:
                expected.append(int(c))
        assert edges.tolist() == expected
