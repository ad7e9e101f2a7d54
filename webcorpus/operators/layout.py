"""Tables laid out by key, so that repeated joins on the key move only the other side."""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.operators import joins
from webcorpus.operators.joins import SALTS, hot_keys, measured_bytes
from webcorpus.session import shared_dir

ROWS = 4_000_000  # rows of a bucket, about


def buckets_for(spark: SparkSession, rows: int) -> int:
    """Buckets for a table; not fewer than the shuffle partitions, or Spark would deal it out anew."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


class Bucketed:
    """A table in the shared folder, in one file per bucket of ``keys`` and write.

    A join or grouping on the keys reads it as it lies, without an exchange.
    """

    def __init__(self, spark: SparkSession, keys: list[str], buckets: int) -> None:
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.name = f"webcorpus_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/{self.name}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)

    def append(self, rows: DataFrame) -> DataFrame:
        """The whole table after ``rows`` were written to it."""
        dealt = rows.repartition(self.buckets, *self.keys)
        writer = dealt.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys)
        writer.option("path", self.path).mode("append").saveAsTable(self.name)
        return self.spark.table(self.name)


class LinkGraph:
    """Links (src, dst) that are followed level by level.

    Sources within the broadcast bound are sent to the links, which are read as they lie. The first
    larger level writes the links once by source, hub pages split by a salt, and from then on only
    the sources are moved: no level exchanges the links.
    """

    def __init__(self, edges: DataFrame) -> None:
        self.edges = edges.select("src", "dst")

    @cached_property
    def hubs(self) -> DataFrame:
        return hot_keys(self.edges, ["src"], joins.HOT_ROWS)

    @cached_property
    def laid_out(self) -> DataFrame:
        spark = self.edges.sparkSession
        salt = F.when(F.col("_hot"), F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int")).otherwise(0)
        rows = self.edges.join(F.broadcast(self.hubs), "src", "left").select("src", salt.alias("salt"), "dst")
        return Bucketed(spark, ["src", "salt"], buckets_for(spark, self.edges.count())).append(rows)

    def targets(self, sources: DataFrame, size: int | None = None) -> DataFrame:
        """(node): distinct nodes one link away from ``sources`` (node), which take ``size`` bytes at most."""
        lookup = sources.select(F.col("node").alias("src"))
        if (measured_bytes(lookup) if size is None else size) <= joins.BROADCAST_BYTES:
            found = self.edges.join(F.broadcast(lookup), "src")
        else:
            every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
            salted = lookup.join(F.broadcast(self.hubs), "src", "left").select("src", F.explode(every).alias("salt"))
            found = self.laid_out.join(salted.hint("merge"), ["src", "salt"])
        return found.select(F.col("dst").alias("node")).distinct()


class Visited:
    """Nodes seen so far; once they are too many to be broadcast they lie by node, and only new ones move."""

    def __init__(self) -> None:
        self.levels, self.size, self.stored, self.whole = [], 0, None, None

    def add(self, nodes: DataFrame, size: int) -> None:
        self.levels.append(nodes.select("node"))
        self.size += size

    def unseen(self, reached: DataFrame) -> DataFrame:
        """Those of ``reached`` (node), which are distinct, that were not seen."""
        if self.levels:
            new = reduce(DataFrame.unionByName, self.levels)
            if self.stored is None and self.size <= joins.BROADCAST_BYTES:
                return reached.join(F.broadcast(new), "node", "left_anti")
            if self.stored is None:
                self.stored = Bucketed(new.sparkSession, ["node"], buckets_for(new.sparkSession, new.count()))
            self.whole, self.levels = self.stored.append(new), []
        return reached.join(self.whole.hint("merge"), "node", "left_anti")
