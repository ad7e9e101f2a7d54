"""Nearest neighbours by inner product on robust-pruned directed graphs, one per shard.

Distinct vectors are dealt into bands of lengths within a factor of 1.2, and these into shards by a
hash. In a band vectors are scaled to its longest and extended by one coordinate that gives all the
length 1, so the largest inner product is the smallest distance, and single precision is enough
whatever lengths other bands have. In a shard, points enter
the graph in growing batches: a greedy search proposes neighbours, relaxed pruning keeps those that
are not much closer to a kept one, and edges run back. Every query is searched in every shard by a
beam; blocks of queries meet whole shards, both of bounded size. Scores are exact.

How wide a beam must be depends on the vectors: on random directions a narrow one misses much. So
each shard measures its own recall against all its products for a small sample of the queries, and
doubles its beam until it finds enough, at last all its points.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 20
BAND = 0.5  # doublings of the squared length in a band
SHARD = 8192  # distinct vectors per graph, about
BLOCK = 1024  # queries that meet a shard at once, about
DEGREE = 24
GROUP = 16  # blocks of queries for which a graph is sent once
BEAM = 96  # of a shard, at least
SAMPLE = 64  # queries on which a shard measures its recall
RECALL = 0.97  # of a shard's nearest, on average over the sample
WORST = 0.6  # the same for each query of the sample
BUILD_BEAM = 64
RELAX = 1.2
WIDTH = 4  # nodes expanded per query and step
ENTRIES = 8


def beam_search(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, known: int, beam: int, products: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the beam of each query over the first ``known`` points, nearest first.

    With ``products`` the inner product alone ranks, as it does for points of one length.
    """
    entries = np.unique(np.linspace(0, known - 1, min(ENTRIES, known)).astype(np.int64))
    if known <= beam:
        entries = np.arange(known)
    n, held = len(queries), max(beam, len(entries))
    norms = np.zeros(known, points.dtype) if products else np.einsum("ij,ij->i", points[:known], points[:known])
    ids = np.full((n, held), -1, np.int64)
    far = np.full((n, held), np.inf, np.float32)
    done = np.ones((n, held), bool)
    ids[:, : len(entries)] = entries
    far[:, : len(entries)] = norms[entries] - 2 * (queries @ points[entries].T)
    done[:, : len(entries)] = known <= beam
    seen = np.zeros((n, known + 1), bool)
    seen[:, entries] = True
    seen[:, known] = True  # stands for no edge
    active = np.arange(n)
    while len(active):
        open_far = np.where(done[active], np.inf, far[active])
        pick = np.argpartition(open_far, WIDTH - 1, axis=1)[:, :WIDTH] if held > WIDTH else np.argsort(open_far, axis=1)
        live = np.isfinite(np.take_along_axis(open_far, pick, 1))
        some = live.any(axis=1)
        active, pick, live = active[some], pick[some], live[some]
        if not len(active):
            break
        rows = active[:, None]
        nodes = np.where(live, ids[rows, pick], known)
        done[rows, pick] = True
        near = np.where(nodes[:, :, None] < known, edges[np.minimum(nodes, len(edges) - 1)], -1).reshape(len(active), -1)
        near = np.where((near < 0) | (near >= known), known, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = known
        near[seen[rows, near]] = known
        seen[rows, near] = True
        fresh = near < known
        at = np.minimum(near, known - 1)
        dots = np.matmul(points[at], queries[active][:, :, None])[:, :, 0]
        gap = np.where(fresh, norms[at] - 2 * dots, np.inf).astype(np.float32)
        all_far = np.concatenate([far[active], gap], axis=1)
        best = np.argpartition(all_far, held - 1, axis=1)[:, :held]
        far[active] = np.take_along_axis(all_far, best, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1), best, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], ~fresh], axis=1), best, 1)
    order = np.argsort(far, axis=1, kind="stable")
    own = np.einsum("ij,ij->i", queries, queries)[:, None]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1) + own


def prune(points: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours of each node among ``found`` (-1: none), nearest first.

    A candidate goes if a kept neighbour is nearer to it than the node is, by the factor ``relax``.
    """
    at = np.maximum(found, 0)
    places = points[at]
    gaps = places - points[nodes][:, None, :]
    far = np.einsum("bcd,bcd->bc", gaps, gaps)
    far[(found < 0) | (found == nodes[:, None])] = np.inf
    norms = np.einsum("bcd,bcd->bc", places, places)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(places, places.transpose(0, 2, 1))
    alive = np.isfinite(far)
    kept = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        choice = np.argmin(np.where(alive, far, np.inf), axis=1)
        live = alive[rows, choice]
        if not live.any():
            break
        kept[:, k] = np.where(live, found[rows, choice], -1)
        alive &= relax * relax * between[rows, choice] > far
        alive[rows, choice] = False
    return kept


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX) -> np.ndarray:
    """(points, degree) out-edges, -1 where there is none. Points should come in random order."""
    n, room = len(points), degree + degree // 2
    edges = np.full((n, room), -1, np.int64)
    known = 1
    while known < n:
        batch = np.arange(known, min(n, known + max(1, min(known, 512))))
        found, _ = beam_search(points, edges, points[batch], known, beam)
        # Points of a batch may also be neighbours of each other.
        mates = np.broadcast_to(batch, (len(batch), len(batch)))
        gaps = np.einsum("ij,ij->i", points[batch], points[batch])[None, :] - 2 * points[batch] @ points[batch].T
        np.fill_diagonal(gaps, np.inf)
        near = np.argsort(gaps, axis=1, kind="stable")[:, :degree]
        out = prune(points, batch, np.concatenate([found[:, :beam], np.take_along_axis(mates, near, 1)], axis=1), degree, relax)
        edges[batch, :degree] = out
        source = np.repeat(batch, degree)[out.ravel() >= 0]
        target = out.ravel()[out.ravel() >= 0]
        order = np.lexsort((source, target))
        source, target = source[order], target[order]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        for size in np.unique(counts):
            for part in np.array_split(np.nonzero(counts == size)[0], max(1, (counts == size).sum() * (room + size) // 60_000)):
                nodes = heads[part]
                new = source[first[part][:, None] + np.arange(size)]
                both = np.concatenate([edges[nodes], new], axis=1)
                both.sort(axis=1)
                both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
                both = -np.sort(-both, axis=1)
                full = (both >= 0).sum(axis=1) > room
                edges[nodes[~full]] = both[~full, :room]
                if full.any():
                    edges[nodes[full]] = -1
                    edges[nodes[full], :degree] = prune(points, nodes[full], both[full], degree, relax)
        known += len(batch)
    return edges


def fitting_beam(points: np.ndarray, edges: np.ndarray, queries: np.ndarray, k: int, beam: int) -> int:
    """The first of ``beam`` and its doubles that finds enough of the ``k`` largest products; at last all points."""
    n = len(points)
    beam, k = max(beam, k), min(k, n)
    if not len(queries):
        return beam
    products = queries @ points.T
    least = np.partition(products, n - k, axis=1)[:, n - k]
    while beam < n:
        found, _ = beam_search(points, edges, queries, n, beam, products=True)
        got = np.where(found >= 0, np.take_along_axis(products, np.maximum(found, 0), 1), -np.inf)
        # Equal products are as good as each other.
        share = np.minimum(1.0, (got >= least[:, None]).sum(axis=1) / k)
        if share.mean() >= RECALL and share.min() >= WORST:
            break
        beam *= 2
    return min(beam, max(n, k))


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Queries of length 1, as a query's length does not change its order, with a zero for the added coordinate."""
    flat = vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]
    return np.concatenate([flat, np.zeros((len(vectors), 1))], axis=1).astype(np.float32)


def _extended(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors scaled to the squared length ``longest``, with a coordinate that makes the length 1."""
    scaled = vectors / np.sqrt(longest)
    rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.concatenate([scaled, rest[:, None]], axis=1).astype(np.float32)


def sound_vectors(vectors: DataFrame) -> DataFrame:
    """Distinct (vec_id, v, dim) without NULL, zero or non-finite vectors and NULL ids."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select("vec_id", v.alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
        .select("vec_id", "v", F.size("v").alias("dim"))
        .distinct()
    )


def nearest(vectors: DataFrame, wanted: str, k: int = K, shard_rows: int = SHARD, block_rows: int = BLOCK, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of each row for which ``wanted`` holds."""
    sound = stored(sound_vectors(vectors))
    # Equal vectors are one point; it stands for its k + 1 smallest ids, enough for any answer.
    first = Window.partitionBy("v").orderBy("vec_id")
    points = stored(
        sound.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.first("dim").alias("dim"), F.min("vec_id").alias("point"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    )
    size = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    # Length 1 lies in the middle of a band.
    points = points.withColumn("size", size).withColumn("band", F.floor(F.log2("size") / BAND + 0.5).cast("int"))
    groups = stored(
        points.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"), (F.max("size") * (1 + 1e-9)).alias("longest"))
    )
    queries = sound.filter(wanted)
    blocks = max(1, -(-queries.count() // block_rows))
    sampled = queries.withColumn("draw", F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64("vec_id", "v"), "vec_id")))
    sample: dict[int, list] = {}
    for r in sampled.filter(F.col("draw") <= SAMPLE).select("dim", "v").collect():
        sample.setdefault(r.dim, []).append(r.v)

    def index(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # A fixed random order, whatever order the rows arrive in.
        group = group.sort_values("point")
        group = group.iloc[np.random.default_rng(3).permutation(len(group))]
        own = np.stack(group["v"].to_numpy())
        longest = float(group["longest"].iloc[0])
        extended = _extended(own, longest)
        graph = build(extended)
        asks = _directions(np.array(sample.get(int(key[0]), []), float).reshape(-1, own.shape[1]))
        width = fitting_beam(extended, graph, asks, k + 1, beam)
        ids, data, edges = group["point"].to_numpy().tobytes(), own.tobytes(), graph.astype(np.int32).tobytes()
        return pd.DataFrame([{"dim": key[0], "band": key[1], "shard": key[2], "longest": longest, "beam": width, "ids": ids, "data": data, "edges": edges}])

    shard = F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")
    graphs = stored(
        points.join(groups, ["dim", "band"])
        .select("dim", "band", shard.alias("shard"), "longest", "point", "v")
        .groupBy("dim", "band", "shard")
        .applyInPandas(index, "dim int, band int, shard int, longest double, beam int, ids binary, data binary, edges binary")
    )
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    asked = (
        queries.groupBy("dim", block.alias("block"))
        .agg(F.collect_list(F.struct("vec_id", "v")).alias("asked"))
        .join(groups.select("dim", "band", "shards"), "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        .drop("shards")
    )
    # Whole shards against blocks of the stated queries, both bounded; a graph is sent once per group
    # of blocks, and its blocks come to it.
    dealt = (F.col("block") % (-(-blocks // GROUP))).alias("group")
    every = F.explode(F.sequence(F.lit(0), F.lit(-(-blocks // GROUP) - 1))).alias("group")
    meets = graphs.select("*", every).join(asked.select("*", dealt).hint("shuffle_merge"), ["dim", "band", "shard", "group"])
    meets = meets.select("ids", "data", "edges", "dim", "asked", "longest", "beam")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, data, edges, dim = (batch.column(c)[r].as_py() for c in range(4))
                ids, own = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
                graph = np.frombuffer(edges, np.int32).reshape(len(ids), -1).astype(np.int64)
                asked = batch.column(4)[r].values
                names = asked.field(0).to_numpy()
                ask = asked.field(1).flatten().to_numpy().reshape(-1, dim)
                longest, width = batch.column(5)[r].as_py(), batch.column(6)[r].as_py()
                found, _ = beam_search(_extended(own, longest), graph, _directions(ask), len(ids), width, products=True)
                # Exact scores decide; k + 1, as a query's own point is among them.
                exact = np.matmul(own[np.maximum(found, 0)], ask[:, :, None])[:, :, 0]
                exact[found < 0] = -np.inf
                take = np.argsort(-exact, axis=1, kind="stable")[:, : k + 1]
                score, point = np.take_along_axis(exact, take, 1), np.take_along_axis(found, take, 1)
                real = np.isfinite(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(names, real.sum(axis=1))), pa.array(ids[point[real]]), pa.array(score[real])], ["query_id", "point", "score"]
                )

    hits = meets.mapInArrow(search, "query_id bigint, point bigint, score double")
    # No answer lies beyond the best k + 1 points: each of them but the query's own has an id to answer with.
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "point")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        hits.withColumn("place", F.row_number().over(first))
        .filter(F.col("place") <= k + 1)
        .join(points.select("point", "members"), "point")
        .select("query_id", F.explode("members").alias("vec_id"), "score")
        .filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op3(vectors: DataFrame) -> DataFrame:
    """The 20 nearest of each row whose vec_id is divisible by 20, among all other rows.

    Rows that repeat both id and vector count once; a row never answers a query of its own id.
    Vectors of other lengths than the query's are not comparable and never answer it. Fewer
    candidates than 20 are all returned; without queries or candidates there are no rows.
    """
    return nearest(vectors, "vec_id % 20 = 0")
