import math

import numpy as np
import pytest

from webcorpus.llm import whitening
from webcorpus.llm.whitening import op11, whiten


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n string")


def sound(rows):
    kept = [(i, [float(np.float32(c)) for c in v]) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dim = max((len(v) for _, v in kept), default=0)
    return [(i, [math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dim - len(v))) for i, v in kept], dim


def random_rows(n, dim, seed=1, offset=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) @ np.diag(np.linspace(0.1, 2, dim)) + 0.3
    return [(offset + i, [float(c) for c in v.astype(np.float32)], 0, "x") for i, v in enumerate(x)]


def check(found, rows, places=1e-8):
    """Counts and deviations exactly, the rest against numpy's whole-matrix results."""
    kept, dim = sound(rows)
    n = len(kept)
    sums = [sum(x[d] for _, x in kept) for d in range(dim)]
    x = np.array([v for _, v in kept], float) - np.array(sums, float) / n
    values, axes = np.linalg.eigh(x.T @ x / n)
    values, axes = values[::-1], axes[:, ::-1]
    wanted = {}
    for k, (i, v) in enumerate(kept):
        wanted.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(v, sums)), x[k]))
    by = {}
    for r in found:
        assert r.n == n
        by.setdefault(r.component, []).append(r)
    assert sorted(by) == list(range(1, min(8, dim) + 1))
    for c, rs in by.items():
        assert len(rs) == n
        got = sorted(((r.vec_id, r.deviation, r.whitened) for r in rs), key=str)
        y = {i: [(dev, float(v @ axes[:, c - 1]) / math.sqrt(values[c - 1])) for dev, v in w] for i, w in wanted.items()}
        flat = sorted(((i, dev, z) for i, w in y.items() for dev, z in w), key=str)
        assert [g[:2] for g in sorted(got, key=lambda g: str(g[:2]))] == [f[:2] for f in sorted(flat, key=lambda f: str(f[:2]))]
        ours = np.array([z for _, _, z in sorted(got, key=lambda g: (str(g[0]), abs(g[2])))])
        theirs = np.array([z for _, _, z in sorted(flat, key=lambda g: (str(g[0]), abs(g[2])))])
        sign = 1 if abs(ours - theirs).max() < abs(ours + theirs).max() else -1
        assert np.allclose(ours, sign * theirs, atol=places)
        assert all(abs(r.explained - values[c - 1] / values.sum()) <= 1e-9 for r in rs)
        assert len({r.identity_error for r in rs}) == 1 and rs[0].identity_error <= 1e-8
        spread = np.array([r.whitened for r in rs])
        assert abs(spread.var() - 1) < 1e-8


def test_against_numpy(spark):
    rows = random_rows(500, 12)
    check(op11(vectors(spark, rows)).collect(), rows)


def test_several_blocks_and_panels(spark):
    rows = random_rows(300, 10, 2)
    whole, axes, n, error = whiten(vectors(spark, rows), block=70, panel_blocks=4)
    parts, own, _, _ = whiten(vectors(spark, rows))
    assert n == 300 and error < 1e-9 and np.allclose(axes.values, own.values)
    a, b = ({r.vec_id: r for r in f.collect()} for f in (whole, parts))
    ya, yb = (np.array([f[i].y for i in range(300)]) for f in (a, b))
    assert np.allclose(ya * np.sign(ya[0]), yb * np.sign(yb[0])) and all(a[i].deviation == b[i].deviation for i in range(300))


def test_odd_vectors(spark):
    rows = random_rows(60, 9, 3)
    rows += [(1000, None, 0, "x"), (1001, [1.0] * 8 + [None], 0, "x"), (1002, [float("nan")] + [0.0] * 8, 0, "x"), (1003, [float("inf")] + [0.0] * 8, 0, "x")]
    rows += [(1004, [0.0] * 9, 0, "x"), (1005, [1.0, 2.0], 0, "x"), (1006, [], 0, "x"), (None, [0.5] * 9, 0, "x")]
    rows += rows[:2] + [(2000 + i, [1.0] * 9, 0, "x") for i in range(30)]  # repeated rows and copies
    check(op11(vectors(spark, rows)).collect(), rows)


def test_directions_without_variance(spark):
    rows = [(i, [float(i), 2.0, -float(i)], 0, "x") for i in range(6)]
    found = op11(vectors(spark, rows)).collect()
    assert len(found) == 18
    assert all((r.whitened is not None) == (r.component == 1) for r in found)
    assert {round(r.explained, 12) for r in found if r.component == 1} == {1.0}
    assert all(r.identity_error < 1e-9 for r in found)


def test_one_row_and_none(spark):
    one = op11(vectors(spark, [(7, [1.0, 2.0], 0, "x")])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(7, c, 1, 0, None, None, None) for c in (1, 2)]
    assert op11(vectors(spark, [])).collect() == []
    assert op11(vectors(spark, [(1, None, 0, "x")])).collect() == []
    assert op11(vectors(spark, [(1, [], 0, "x")])).collect() == []


def test_entries_beyond_a_long(spark):
    rows = [(i, [float(np.float32(10.0 ** (3 * i))), 1.0 * i], 0, "x") for i in range(12)]
    found = op11(vectors(spark, rows)).collect()
    kept = [(i, [math.floor(min(1024 * c, 2.0**52)) + 100_000 for c in v]) for i, v, *_ in rows]
    sums = [sum(x[d] for _, x in kept) for d in range(2)]
    for r in found:
        exact = sum((12 * c - s) ** 2 for c, s in zip(kept[r.vec_id][1], sums))
        assert int(r.deviation_exact) == exact and r.deviation == (exact if exact < 2**63 else None)


def test_given_vectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    check(op11(table).collect(), [(r.vec_id, r.embedding) for r in table.collect()])


def test_parts_fill_panels():
    assert whitening.panels_of([(0, 5), (2, 5), (3, 1), (7, 20), (8, 2)], 10) == [[(0, 5), (2, 5)], [(3, 1)], [(7, 20)], [(8, 2)]]
    assert whitening.panels_of([], 10) == []


@pytest.mark.parametrize("most", [3, 1 << 61, 1 << 80])
def test_sums_stay_exact(most):
    assert whitening._most(np.array([most, -1], object if most > 1 << 62 else np.int64)) == most
