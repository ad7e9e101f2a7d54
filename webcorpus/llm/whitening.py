"""Whitened embeddings by products of distributed block matrices.

Vectors become whole numbers, so their sums and each row's deviation are exact. Centred rows, with a
gapless index, are dealt into the blocks of MLlib's BlockMatrix; its transpose times itself is the
scatter, whose eigenvectors are found locally, and the rows times the scaled eigenvectors are the
whitened rows. MLlib lays a tall matrix on about as many partitions as the square root of its input
has, and holds what meets in one in memory. So the rows come in panels of bounded size, each a
matrix of its own: more rows mean more panels, not larger partitions.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.llm.common import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCALE, SHIFT = 1024, 100_000
WIDEST = 2.0**52  # scaled entries beyond are taken as this: doubles hold no more whole numbers
COMPONENTS = 8
BLOCK = 1 << 17  # numbers in a block, about: 1 MB
PANEL = 1 << 10  # blocks of rows in a panel, at most: 1 GB
NO_VARIANCE = 1e-12  # share of the trace below which an eigenvalue is zero

_EXACT = 1 << 62


@dataclass
class Axes:
    """Directions of most variance: unit ``vectors`` by column, their ``values``, and the whole ``trace``."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def weights(self) -> np.ndarray:
        """What takes a centred row to its whitened one; zero for a direction without variance."""
        sound = self.values > NO_VARIANCE * self.trace
        return np.where(sound, self.vectors / np.sqrt(np.where(sound, self.values, 1)), 0.0)


def whole_numbers(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x): entries times 1024, rounded down, plus 100000.

    Vectors that are NULL or hold NULL or non-finite entries go; ids may be NULL or repeat.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform("v", lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(WIDEST)), F.lit(-WIDEST))) + SHIFT)
    return rows.filter(F.col("v").isNotNull() & finite).select("vec_id", scaled.alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers; a shorter vector goes on with zeros, which are SHIFT here."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.full((len(column), dim), SHIFT, np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def sums_of(numbered: DataFrame, dim: int) -> list[int]:
    """Exact sums of each dimension: a row per batch and dimension is added up by Spark."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total = (x if _most(x) * (len(x) + 1) < _EXACT else x.astype(object)).sum(axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dim), pa.int32()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))], ["at", "total"]
            )

    parts = numbered.select("x").mapInArrow(add, "at int, total decimal(38,0)")
    return [int(r.total) for r in parts.groupBy("at").agg(F.sum("total").alias("total")).orderBy("at").collect()]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x-S for rows of whole numbers, exactly: as longs where they fit, else as Python's numbers."""
    small = max(map(abs, sums), default=0)
    if small < _EXACT and n * _most(x) + small < _EXACT:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred_rows(numbered: DataFrame, first: dict[int, int], n: int, sums: list[int]) -> DataFrame:
    """(place, vector): the rows less the mean, numbered from what ``first`` says of their part."""
    dim = len(sums)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, part, place = batch.columns
            y = (deviations(_matrix(column, dim), n, sums) / n).astype(np.float64)
            at = np.array([first[p] for p in part.to_pylist()], np.int64) + place.to_numpy()
            ends = np.arange(0, y.size + 1, dim, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], ["place", "v"])

    rows = numbered.select("x", "part", "place").mapInArrow(centre, "place bigint, v array<double>")
    return MLUtils.convertVectorColumnsFromML(rows.select("place", array_to_vector("v").alias("vector")), "vector")


def row_facts(numbered: DataFrame, panel: dict[int, tuple[int, int]], n: int, sums: list[int]) -> DataFrame:
    """(panel, place, vec_id, deviation, deviation_exact); ``panel`` has each part's panel and first place.

    deviation_exact is the sum of (n*x-S)^2 with up to 38 digits, deviation the same where it fits a
    long; both are NULL beyond.
    """
    dim = len(sums)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, column, part, place = batch.columns
            y = deviations(_matrix(column, dim), n, sums)
            square = (y if _most(y) ** 2 * max(1, dim) < _EXACT else y.astype(object)) ** 2
            total = [int(t) for t in square.sum(axis=1)]
            parts = [panel[p] for p in part.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in parts], pa.int32()),
                    pa.array(np.array([at for _, at in parts], np.int64) + place.to_numpy()),
                    vec_id,
                    pa.array([t if t < 1 << 63 else None for t in total], pa.int64()),
                    pa.array([Decimal(t) if t < 10**38 else None for t in total], pa.decimal128(38, 0)),
                ],
                ["panel", "place", "vec_id", "deviation", "deviation_exact"],
            )

    schema = T.StructType.fromDDL("panel int, place bigint, vec_id bigint, deviation bigint, deviation_exact decimal(38,0)")
    schema["vec_id"].dataType = numbered.schema["vec_id"].dataType
    return numbered.select("vec_id", "x", "part", "place").mapInArrow(tell, schema)


def panels_of(parts: list[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Consecutive parts (number, rows) in groups of at most ``most`` rows; a larger part is alone."""
    groups: list[list[tuple[int, int]]] = []
    held = most + 1
    for part in parts:
        if held + part[1] > most:
            groups.append([])
            held = 0
        groups[-1].append(part)
        held += part[1]
    return groups


def block_matrix(rows: DataFrame, n: int, dim: int, block_rows: int) -> BlockMatrix:
    """Blocks of the rows (place, vector) of one panel; the rows stay in the JVM.

    They are used several times, so they are kept where there is room; what an executor takes with
    it is made again from the shuffled rows.
    """
    return IndexedRowMatrix(rows, n, dim).toBlockMatrix(block_rows, dim).persist(StorageLevel.MEMORY_AND_DISK)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """The product, with the blocks that are summed dealt over ``splits`` tasks."""
    other = right._java_matrix_wrapper._java_model
    return BlockMatrix(left._java_matrix_wrapper.call("multiply", other, splits), left.rowsPerBlock, right.colsPerBlock)


def axes_of(scatter: np.ndarray, n: int, keep: int = COMPONENTS) -> Axes:
    """Eigenvectors of the covariance by falling eigenvalue, ``keep`` of them at most."""
    covariance = (scatter + scatter.T) / (2 * n)
    values, vectors = np.linalg.eigh(covariance)
    return Axes(vectors[:, ::-1][:, :keep], np.maximum(values[::-1][:keep], 0.0), float(np.trace(covariance)))


def whitened_rows(spark: SparkSession, panels: list[BlockMatrix], axes: Axes) -> DataFrame:
    """(panel, place, y): every row on the axes, over the root of their variance; each panel is stored."""
    dim, keep = axes.weights.shape
    local = Matrices.dense(dim, keep, axes.weights.ravel(order="F"))
    weights = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), dim, keep, dim, keep)
    found = None
    for k, panel in enumerate(panels):
        product = panel.multiply(weights).toIndexedRowMatrix()
        rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
        part = stored(rows.select(F.lit(k).alias("panel"), F.col("index").alias("place"), vector_to_array("vector").alias("y")))
        panel._java_matrix_wrapper._java_model.blocks().unpersist(False)
        found = part if found is None else found.unionAll(part)
    return found


def identity_error(white: DataFrame, n: int, sound: list[int]) -> float | None:
    """Largest entry by which the covariance of the whitened rows differs from the identity."""
    if not sound:
        return None
    means = white.agg(*[(F.sum(F.get("y", F.lit(i))) / n).alias(f"m{i}") for i in sound]).first()
    pairs = [(i, j) for i in sound for j in sound if i <= j]
    off = {i: F.get("y", F.lit(i)) - F.lit(means[f"m{i}"]) for i in sound}
    row = white.agg(*[(F.sum(off[i] * off[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    keep: int = COMPONENTS,
    block: int = BLOCK,
    panel_blocks: int = PANEL,
) -> tuple[DataFrame, Axes, int, float | None]:
    """(rows, axes, n, identity_error); rows are (vec_id, deviation, deviation_exact, y array<double>).

    y holds the whitened entries by component. Vectors shorter than the longest go on with zeros.
    A component without variance has y = 0 here. Without rows or dimensions there are no axes.
    """
    spark = vectors.sparkSession
    # A row's number is written with it, so that reading the table in other splits changes nothing.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    numbered = stored(whole_numbers(vectors, vec_id, embedding).select("*", F.spark_partition_id().alias("part"), place.alias("place")), "part")
    # One row per written part comes to the driver.
    parts = numbered.groupBy("part").agg(F.count("*").alias("rows"), F.max(F.size("x")).alias("dim")).orderBy("part").collect()
    n, dim = sum(p.rows for p in parts), max((p.dim for p in parts), default=0)
    if not n or not dim:
        none = F.lit(None)
        empty = numbered.select("vec_id", none.cast("bigint").alias("deviation"), none.cast("decimal(38,0)").alias("deviation_exact"), F.array().cast("array<double>").alias("y"))
        return empty, Axes(np.zeros((0, 0)), np.zeros(0), 0.0), n, None
    sums = sums_of(numbered, dim)
    block_rows = max(1, block // dim)
    panels, scatter, where = [], np.zeros((dim, dim)), {}
    for k, group in enumerate(panels_of([(p.part, p.rows) for p in parts], block_rows * panel_blocks)):
        first = dict(zip([p for p, _ in group], np.cumsum([0, *(r for _, r in group)]).tolist()))
        where.update((p, (k, at)) for p, at in first.items())
        size = sum(r for _, r in group)
        rows = centred_rows(numbered.filter(F.col("part").between(group[0][0], group[-1][0])), first, n, sums)
        panels.append(block_matrix(rows, size, dim, block_rows))
        scatter += _times(panels[-1].transpose(), panels[-1], -(-size // block_rows)).toLocalMatrix().toArray()
    axes = axes_of(scatter, n, keep)
    white = whitened_rows(spark, panels, axes)
    sound = [i for i, e in enumerate(axes.values) if e > NO_VARIANCE * axes.trace]
    error = identity_error(white, n, sound)
    facts = row_facts(numbered, where, n, sums)
    out = facts.join(white, ["panel", "place"]).select("vec_id", "deviation", "deviation_exact", "y")
    return out, axes, n, error


def op11(vectors: DataFrame) -> DataFrame:
    """Every remaining row on each of the first 8 components, with what they explain.

    Vectors that are NULL or hold NULL or non-finite entries go; zero vectors, repeated rows and
    NULL ids stay. whitened is NULL for a component without variance, explained is NULL where nothing
    varies, identity_error covers the components with variance. No rows without a remaining vector.
    """
    rows, axes, n, error = whiten(vectors)
    shares = [float(e / axes.trace) if axes.trace > 0 else None for e in axes.values]
    sound = [bool(e > NO_VARIANCE * axes.trace) for e in axes.values]
    facts = F.array(*[F.struct(F.lit(s).cast("double").alias("explained"), F.lit(v).alias("sound")) for s, v in zip(shares, sound)])
    if not shares:
        facts = F.array().cast("array<struct<explained: double, sound: boolean>>")
    spread = rows.select("vec_id", "deviation", "deviation_exact", F.posexplode(F.arrays_zip(F.col("y"), facts.alias("f"))).alias("at", "c"))
    return spread.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.when(F.col("c.f.sound"), F.col("c.y")).alias("whitened"),
        F.col("c.f.explained").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
        "deviation_exact",
    )
