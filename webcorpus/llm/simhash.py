"""SimHash near-duplicates: exact comparison of fingerprints in tiles of equal population counts.

The Hamming distance of two fingerprints is at least the sum over their 16-bit words of the
differences between the words' population counts. Fingerprints are tiled by these counts: the
first two words make cells, which Spark joins to the cells within the radius; the last two make
tiles inside a cell. Tile pairs whose counts differ by more than the radius are skipped; all others
are compared exactly by exclusive-or and bit counts in numpy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.common import LOWER, components, stored, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
WIDTH = 4
RADIUS = 4
CHUNK = 16_384  # fingerprints of a cell that one task holds on either side
BLOCK = 1 << 18  # comparisons made at once


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """64 majority bits of the hashes of all shingles, as a signed integer."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    count = max(1, len(words) - width + 1)
    hash64 = xxhash.xxh64_intdigest
    if count == 1:
        hashes = [hash64(joined, SEED)]
    else:
        ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
        starts = [0, *(end + 1 for end in ends[: count - 1])]
        hashes = [hash64(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :])]
    ones = np.zeros(64, np.int64)
    for at in range(0, count, 65_536):
        part = np.array(hashes[at : at + 65_536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<i8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as bigint; zero for NULL and texts without words."""

    @F.arrow_udf("bigint")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())

    return of(utf8(text))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class _Forest:
    """Classes of n nodes, kept as the root of every node."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        left, right = self.root[a], self.root[b]
        apart = left != right
        if not apart.any():
            return
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            path = []
            while x in parent:
                path.append(x)
                x = parent[x]
            parent.update((p, x) for p in path)
            return x

        for x, y in np.unique(np.stack([left[apart], right[apart]], axis=1), axis=0).tolist():
            x, y = top(x), top(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        change = np.arange(len(self.root))
        for x in list(parent):
            change[x] = top(x)
        self.root = change[self.root]


def _tiled(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Order by the counts of words two and three, and (count, count, start, end) of each tile."""
    third = np.bitwise_count((fps >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)
    fourth = np.bitwise_count(fps >> np.uint64(48)).astype(np.int64)
    order = np.lexsort((fourth, third))
    keys, starts = np.unique((third * 17 + fourth)[order], return_index=True)
    ends = [*starts[1:].tolist(), len(fps)]
    return order, [(k // 17, k % 17, s, e) for k, s, e in zip(keys.tolist(), starts.tolist(), ends)]


def link_cells(left: np.ndarray, right: np.ndarray, apart: int, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, root): a forest of the links between two chunks that differ by ``apart``.

    A forest, not all pairs: it joins the same fingerprints, and a group of n near copies
    yields n rows instead of n squared.
    """
    a, b = left.view(np.uint64), right.view(np.uint64)
    a_order, a_tiles = _tiled(a)
    b_order, b_tiles = _tiled(b)
    a, b = a[a_order], b[b_order]
    forest = _Forest(len(a) + len(b))
    at = {(p, q): (s, e) for p, q, s, e in b_tiles}
    room = radius - apart
    near = [(p, q) for p in range(-room, room + 1) for q in range(abs(p) - room, room - abs(p) + 1)]
    for p, q, start, end in a_tiles:
        for dp, dq in near:
            if (p + dp, q + dq) not in at:
                continue
            first, last = at[p + dp, q + dq]
            rows = max(1, BLOCK // (last - first))
            for s in range(start, end, rows):
                for f in range(first, last, BLOCK):
                    part, other = a[s : min(end, s + rows)], b[f : min(last, f + BLOCK)]
                    hits = np.bitwise_count(part[:, None] ^ other[None, :]) <= radius
                    if hits.any():
                        x, y = np.nonzero(hits)
                        forest.link(x + s, y + len(a) + f)
    every = np.concatenate([a, b]).view(np.int64)
    moved = np.nonzero(forest.root != np.arange(len(every)))[0]
    return [(x, y) for x, y in zip(every[moved].tolist(), every[forest.root[moved]].tolist()) if x != y]


def links(fps: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): edges that connect distinct fingerprints ``fp`` exactly as all pairs within ``radius``.

    Cells are split into chunks by a hash, so a task holds about two chunks, however full a cell is.
    """
    word = lambda k: F.bit_count(F.shiftright("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)))
    cells = fps.select("fp", word(0).alias("p"), word(1).alias("q"))
    # At most 17 x 17 rows.
    parts = cells.groupBy("p", "q").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    chunks = stored(
        cells.join(F.broadcast(parts), ["p", "q"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("parts")))
        .groupBy("p", "q", "chunk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = [
        F.struct(F.lit(dp).alias("dp"), F.lit(dq).alias("dq"))
        for dp in range(0, radius + 1)
        for dq in range(dp - radius, radius - dp + 1)
        if dp > 0 or dq >= 0
    ]
    left = chunks.select(
        F.col("p").alias("lp"), F.col("q").alias("lq"), F.col("chunk").alias("lchunk"),
        F.col("fps").alias("lfps"), F.explode(F.array(*steps)).alias("step"),
    ).select("lchunk", "lfps", "step", (F.col("lp") + F.col("step.dp")).alias("p"), (F.col("lq") + F.col("step.dq")).alias("q"))
    apart = F.col("step.dp") + F.abs("step.dq")
    pairs = left.join(chunks, ["p", "q"]).filter((apart > 0) | (F.col("lchunk") <= F.col("chunk")))
    pairs = pairs.select("lfps", "fps", apart.alias("apart"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (batch.column(c)[k].values.to_numpy() for c in (0, 1))
                found = link_cells(x, y, batch.column(2)[k].as_py(), radius)
                if found:
                    a, b = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    # Comparing is the work, and a row of pairs is up to two chunks: spread the rows evenly.
    spread = pairs.repartition(F.xxhash64("lfps", "fps"))
    return spread.mapInArrow(compare, "a bigint, b bigint")


def _groups(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, fp), and (fp, root, first) with the first row (absent, doc_id, tag) of a group."""
    marked = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            fingerprints(F.col(text)).alias("fp"),
            F.xxhash64(text).alias("tag"),
        )
    )
    # Copies meet here, pre-aggregated, and are one fingerprint from then on.
    row = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "tag")
    distinct = stored(marked.groupBy("fp").agg(F.min(row).alias("low")))
    found = components(links(distinct.select("fp")))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root")
    )
    return marked, stored(
        named.join(named.groupBy("root").agg(F.min("low").alias("first")), "root").select(
            "fp", "root", "first"
        )
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and the smallest id of its group.

    Texts without words have fingerprint zero and link like any other. NULL ids are never the
    smallest; a group without ids has component NULL. Repeated rows stay repeated; no rows give none.
    """
    marked, lookup = _groups(docs, text, doc_id)
    lookup = lookup.select("fp", F.col("first.doc_id").alias("component_id"))
    return marked.join(lookup, "fp", "left").select("doc_id", "fp", "component_id")


def op9(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; NULL and wordless texts share fingerprint zero.

    Rows that repeat an id each have their fingerprint. Ties of bits count as 0, as over half must be set.
    """
    return near_duplicates(docs).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each group the row with the smallest id stays.

    Rows that repeat an id are told apart by a hash of their text; of wholly equal rows one stays,
    of rows that differ in other columns only the first by these. Columns are those of ``docs``.
    """
    _, lookup = _groups(docs, "text", "doc_id")
    first = lookup.filter("fp = root").select(
        F.col("first.doc_id").alias("__llm_id"), F.col("first.tag").alias("__llm_tag")
    )
    tagged = docs.withColumn("__llm_own", F.xxhash64("text"))
    kept = tagged.join(
        first,
        tagged["doc_id"].eqNullSafe(first["__llm_id"]) & (tagged["__llm_own"] == first["__llm_tag"]),
        "left_semi",
    )
    rest = [F.col(f"`{n}`") for n in docs.columns if n not in ("doc_id", "text")]
    order = Window.partitionBy("doc_id", "__llm_own").orderBy(*(rest or [F.lit(0)]))
    ranked = kept.withColumn("__llm_rank", F.row_number().over(order)).filter("__llm_rank = 1")
    return ranked.select(*(f"`{n}`" for n in docs.columns))
