"""Near-duplicate vectors by cosine similarity, exactly.

Unit vectors are dealt into cells around pivots, each to its most similar one. Another vector within
the threshold may have another pivot; by the triangle inequality it then lies no farther than the
threshold's distance from the plane between the two cells. Whoever lies that close to a plane is
also put into the cell behind it, so every similar pair meets in the cell of each of the two. Large
cells are dealt again around pivots of their own. Where no pivots part the vectors, as where all lie
far apart in all directions, a cell is left whole and compared in tiles: time then grows with the
square of the cell, but what is moved grows with the cell, as the number of its parts is fixed until
a part no longer fits a task. Nothing depends on chance but the time it takes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.operators.joins import lookup_join
from webcorpus.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 128
LEAF = 8192  # a cell is dealt on if it has more pairs than this squared
GAIN = 2.0  # times by which dealing must lessen the pairs
PACK = 1024  # vectors that meet their cell's pivots at once, about
PARTS = 12  # a cell too large for one task is dealt into this many parts, and each vector sent once a part
PART = 2048  # vectors that are worth a part of their own
PART_BYTES = 64 << 20  # a task holds two parts, so only larger ones call for more of them


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of one length from a list array."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(vectors), -1)


def unit_vectors(vectors: DataFrame, row_id: str, embedding: str) -> DataFrame:
    """(id, v): vectors of length one as doubles; zero vectors are similar to nothing and left out."""
    values = F.col(embedding).cast("array<double>")
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x * x)
    normed = vectors.select(
        F.col(row_id).alias("id"), values.alias("v"), F.sqrt(squares).alias("norm")
    ).filter("norm > 0")
    return normed.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))


def cells_of(own: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(the home cell of each vector, which cells it must be in) for links no longer than ``reach``."""
    near = own @ pivots.T
    home = near.argmax(axis=1)
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * pivots @ pivots.T))
    # (p - q) . x is the distance of x from the plane between p and q, times |p - q|.
    ahead = near[np.arange(len(own)), home][:, None] - near
    return home, ahead <= reach * apart[home] + 1e-9


def metric_cells(
    units: DataFrame, threshold: float, pivots: int = PIVOTS, leaf: int = LEAF, pack: int = PACK
) -> DataFrame:
    """(cell, id, v, home): vectors by cell; each pair at the threshold meets in both home cells.

    Only members that are at home in a cell need to be compared with all of its members. Pivots
    are the members at home with the smallest hashes; packs of vectors meet the pivots of their
    cell, so a cell of any size is dealt by many tasks. Vectors of one length make up the first cells.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    rows = cut_lineage(units.select(F.size("v").cast("string").alias("cell"), "id", "v", F.lit(True).alias("home")))
    done = []

    def dealt(batch: pa.RecordBatch) -> Iterator[tuple]:
        for cell, members, chosen in zip(*(batch.column(c) for c in ("cell", "members", "pivots"))):
            own = members.values
            home, inside = cells_of(_matrix(own.field("v")), _matrix(chosen.values), reach)
            at_home = own.field("home").to_numpy(zero_copy_only=False)
            yield cell.as_py(), own, home, inside, at_home

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell, _, home, inside, at_home in dealt(batch):
                n = inside.shape[1]
                homes = np.bincount(home[at_home], minlength=n)
                columns = [pa.array([cell] * n), pa.array(range(n), pa.int32()), pa.array(homes), pa.array(inside.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "sub", "homes", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            live = batch.column("live")
            for k, (cell, own, home, inside, at_home) in enumerate(dealt(batch)):
                for sub in live[k].as_py():
                    rows = np.flatnonzero(inside[:, sub])
                    if len(rows):
                        taken = own.take(pa.array(rows))
                        stays = at_home[rows] & (home[rows] == sub)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f"{cell}.{sub}"] * len(rows)), taken.field("id"), taken.field("v"), pa.array(stays)],
                            ["cell", "id", "v", "home"],
                        )

    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes"))
        large = cut_lineage(sizes.filter(F.col("n") * F.col("homes") > leaf * leaf))
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        marked = lookup_join(rows, large, "cell", spread_by="id")
        done.append(marked.filter("n IS NULL").select("cell", "id", "v", "home"))
        opened = marked.filter("n IS NOT NULL").withColumn("draw", F.xxhash64("id"))
        # A few times as many as are wanted, by their hash, so that no task ranks a whole cell.
        thin = F.pmod(F.col("draw"), F.lit(1 << 30)) < F.lit(4.0 * pivots * (1 << 30)) / F.col("homes")
        ranked = opened.filter("home").filter(thin).withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("draw", "id")))
        chosen = ranked.filter(F.col("k") <= pivots).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", "v")))["v"].alias("pivots"))
        salt = F.pmod(F.col("draw"), F.ceil(F.col("n") / pack)).alias("salt")
        packs = opened.groupBy("cell", salt).agg(F.collect_list(F.struct("id", "v", "home")).alias("members"))
        packs = cut_lineage(lookup_join(packs, chosen, "cell", spread_by="salt", settle=True))
        counted = packs.filter("pivots IS NOT NULL").mapInArrow(count, "cell string, sub int, homes bigint, n bigint")
        subs = cut_lineage(counted.groupBy("cell", "sub").agg(F.sum("homes").alias("homes"), F.sum("n").alias("n")))
        worth = subs.groupBy("cell").agg(
            F.sum(F.col("homes") * F.col("n")).alias("left"),
            F.collect_list(F.when((F.col("homes") > 0) & (F.col("n") > 1), F.col("sub"))).alias("live"),
        )
        parted = worth.join(large, "cell").filter(F.col("left") * GAIN <= F.col("n") * F.col("homes")).select("cell", "live")
        judged = lookup_join(packs, parted, "cell", spread_by="salt", settle=True)
        whole = judged.filter("live IS NULL").select("cell", F.inline("members"))
        done.append(whole.select("cell", "id", "v", "home"))
        rows = cut_lineage(judged.filter("live IS NOT NULL").mapInArrow(deal, "cell string, id bigint, v array<double>, home boolean"))


def tiles(cells: DataFrame, block: int | None = None) -> DataFrame:
    """(cell, low, high, part, id, v, home): rows of one (cell, low, high) are what one task compares.

    A cell is dealt into parts, and each pair of parts is a tile, so no task holds more than two
    parts and a vector is sent as often as there are parts. ``block`` bounds the vectors of a part;
    by default their bytes do. Cells of one vector go.
    """
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).filter("n > 1")
    most = F.lit(block) if block else F.greatest(F.lit(1), F.floor(F.lit(PART_BYTES) / (8 * F.col("width"))))
    parts = F.greatest(F.ceil(F.col("n") / most), F.least(F.lit(PARTS), F.ceil(F.col("n") / PART)))
    placed = lookup_join(cells, sizes.select("cell", parts.alias("parts")), "cell", "inner", spread_by="id", settle=True)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    others = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    met = placed.select("cell", "id", "v", "home", "part", others)
    return met.select("cell", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "id", "v", "home")


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): all that hang together have the smallest label among them."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped


def _linked(own: np.ndarray, label: np.ndarray, rows: np.ndarray, columns: np.ndarray, threshold: float) -> np.ndarray:
    """Labels after comparing all ``rows`` with all ``columns``.

    Single precision settles all pairs but those nearer to the threshold than its error.
    """
    slack = 1.2e-7 * (own.shape[1] + 8)
    single = own.astype(np.float32)
    for left in range(0, len(columns), 8192):
        across = columns[left : left + 8192]
        right = single[across].T
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            near = single[some] @ right
            i, j = np.nonzero(near >= threshold - slack)
            sure = near[i, j] >= threshold + slack
            a, b = some[i], across[j]
            unsure = np.flatnonzero(~sure)
            sure[unsure] = np.einsum("ij,ij->i", own[a[unsure]], own[b[unsure]]) >= threshold
            label = merged(label, a[sure], b[sure])
    return label


def similar_links(
    units: DataFrame,
    threshold: float,
    pivots: int = PIVOTS,
    leaf: int = LEAF,
    block: int | None = None,
) -> DataFrame:
    """(a, b): links that connect the vectors as all pairs of at least ``threshold`` do.

    Within a tile a link to the first of its class replaces a vector's pairs: a group of n copies
    yields n rows, not n squared.
    """
    cells = cut_lineage(metric_cells(units, threshold, pivots, leaf))

    def compare(rows: pa.Table) -> pa.Table:
        ids, own = rows["id"].to_numpy(), _matrix(rows["v"].combine_chunks())
        part, home = rows["part"].to_numpy(), rows["home"].to_numpy()
        first = part == part.min()
        second = ~first if not first.all() else first
        label = np.arange(len(ids))
        label = _linked(own, label, np.flatnonzero(first & home), np.flatnonzero(second), threshold)
        if second is not first:
            label = _linked(own, label, np.flatnonzero(second & home), np.flatnonzero(first & ~home), threshold)
        moved = label != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[label[moved]]})

    return tiles(cells, block).groupBy("cell", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the undirected ``edges`` (a, b).

    Each round takes the smallest label among the neighbours and then the label of that label,
    so long chains shrink quickly; it ends when no label changes.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.filter("a <> b").select(F.inline(ways)).distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_low"))
        .select("node", F.least("node", "_low").alias("component"))
    )
    while True:
        near = (
            lookup_join(both, labels.withColumnRenamed("node", "b"), "b", "inner", spread_by="a")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("_low"))
        )
        lowered = labels.join(near, "node").select(
            "node",
            F.col("component").alias("_old"),
            F.least("component", "_low").alias("_label"),
        )
        jump = labels.select(F.col("node").alias("_label"), F.col("component").alias("_next"))
        jumped = cut_lineage(
            lookup_join(lowered, jump, "_label", spread_by="node").select(
                "node", "_old", F.least("_label", "_next").alias("component")
            )
        )
        changed = not jumped.filter("component <> _old").isEmpty()
        labels = jumped.drop("_old")
        if not changed:
            return labels


def cosine_dedup(vectors: DataFrame, row_id: str, embedding: str, threshold: float = 0.9) -> DataFrame:
    """(row_id, cluster, is_duplicate): clusters of similar vectors, named by their smallest id.

    Every pair of at least ``threshold`` is found. Exact copies are merged before anything is
    compared; they meet on a 128-bit hash. Vectors of different lengths are never similar.
    """
    units = unit_vectors(vectors, row_id, embedding)
    hashes = F.struct(F.xxhash64("v", F.lit(1)).alias("h"), F.xxhash64("v", F.lit(2)).alias("g"))
    keyed = units.withColumn("key", hashes)
    copies = cut_lineage(keyed.groupBy("key").agg(F.min_by(F.struct("id", "v"), "id").alias("one")))
    members = keyed.select(F.col("id").alias("member"), "key")
    heads = copies.select("key", F.col("one.id").alias("head"))
    copy_links = members.join(heads, "key").filter("member <> head")
    links = similar_links(copies.select("one.*"), threshold)
    edges = links.union(copy_links.select("member", "head"))
    components = connected_components(edges)
    ids = vectors.select(F.col(row_id).alias("node"))
    return ids.join(components, "node", "left").select(
        F.col("node").alias(row_id),
        F.coalesce("component", "node").alias("cluster"),
        F.coalesce(F.col("component") != F.col("node"), F.lit(False)).alias("is_duplicate"),
    )
