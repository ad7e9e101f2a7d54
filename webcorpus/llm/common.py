"""Pieces shared by the operators: stored tables, hashes of ids, words, connected components."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.session import cut_lineage, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words are runs of anything but \x20 and \x09-\x0D; bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Lower-case words of letters and digits; ASCII punctuation and blanks part them."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PLAIN).split()


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; gone when the session ends.

    With columns ``by`` each of their values has a folder of its own, so a filter on them reads only
    that. The files outlive any executor, so later stages never recompute what made them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def utf8(text: Column) -> Column:
    """The bytes of a text, empty for NULL."""
    return F.coalesce(text, F.lit("")).cast("binary")


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns of two tables; NULL equals NULL."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that ``edges`` (a, b) reach; only nodes with an edge.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    chains shrink by doubling. A round is written to the checkpoint folder before the next.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(edges.filter("a <> b").select(F.inline(ways)).distinct())
    labels = cut_lineage(
        both.groupBy(F.col("a").alias("node"))
        .agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("component"))
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("low"))
        )
        lowered = labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "low").alias("label")
        )
        step = labels.select(F.col("node").alias("label"), F.col("component").alias("next"))
        moved = cut_lineage(
            lowered.join(step, "label", "left").select(
                "node", "old", F.least("label", "next").alias("component")
            )
        )
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels
