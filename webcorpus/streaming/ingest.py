"""Continuous page arrivals and running streams to a table."""

from __future__ import annotations

import datetime as dt
import hashlib
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webcorpus.functions.urls import route_of
from webcorpus.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FAR = dt.datetime(9000, 1, 1)
NO_ROUTE = "\0"  # the key of pages without an address


def stream_table(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files: str = "*.parquet",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files as they arrive in ``folder``, those with a matching name."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def given(folder: str, name: str) -> str:
    """A given table as a path to stream from, be it one file or a folder of files.

    A plain path of a stream must be a folder; a pattern, which matches just this name, may be either.
    """
    return f"{folder}/{{{name}}}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for the start of a query; '__' stands for '.'. They are put back."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def drain(stream: DataFrame, name: str, out: str | None = None, state: str | None = None) -> DataFrame:
    """Process everything that is available now and read the result back as a table.

    A caller that names ``out`` and ``state`` goes on where the last call of that name ended.
    """
    spark = stream.sparkSession
    out = out or scratch(spark, name)
    state = state or scratch(spark, f"{name}-state")
    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=STATE_STORE,
        spark__sql__streaming__sessionWindow__merge__sessions__in__local__partition="true",
    ):
        query = (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", state)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replay(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files: str,
    ts: str,
    job: Callable[[DataFrame], DataFrame],
    name: str,
) -> DataFrame:
    """Run a streaming job over all files there are and close every window.

    After the files a single row with a time in the far future, and NULL elsewhere, moves the
    watermark past all requests, so nothing is left in the state. It arrives in a second run on
    the same state, which is how a stopped job goes on.
    """
    end = scratch(spark, f"{name}-end")
    spark.createDataFrame([], schema).write.parquet(end)
    out, state = scratch(spark, name), scratch(spark, f"{name}-state")

    def run() -> DataFrame:
        arrivals = stream_table(spark, folder, schema, files)
        return drain(job(arrivals.unionByName(stream_table(spark, end, schema))), name, out, state)

    run()
    last = [tuple(FAR if f.name == ts else None for f in schema.fields)]
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    spark.createDataFrame(last, nullable).write.mode("append").parquet(end)
    return run()


def first_pages(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The page of the smallest id of a route that has no page yet; its state says that it has one."""
    held, best = state.exists, None
    for part in parts:
        held = held or bool(part["known"].any())
        new = part[~part["known"]]
        if not held and len(new):
            both = new if best is None else pd.concat([best, new])
            least = both[both["page_id"] == both["page_id"].min()]
            best = least.sort_values(["url", "html"]).iloc[:1]
    if not state.exists:
        state.update((True,))
    if not held and best is not None:
        yield best[["route", "page_id", "named", "url", "html"]]


def seed_routes(spark: SparkSession, store: str, seeds: str, own: str) -> None:
    """Copy the routes of finished batches of other queries to ``seeds``, those not copied before.

    A batch is copied once in the life of a state folder, so a restart reads only what is new.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def listed(folder: str) -> dict[str, bool]:
        """Batches in a folder, which is made if there is none, and whether their writing ended."""
        place = files.Path(folder)
        system = place.getFileSystem(conf)
        system.mkdirs(place)
        found = [f.getPath() for f in system.listStatus(place)]
        return {f.getName(): system.exists(files.Path(f, "_SUCCESS")) for f in found if f.getName().startswith("batch=")}

    copied = listed(seeds)
    new = sorted(b for b, ended in listed(store).items() if ended and b not in copied and not b.startswith(f"batch={own}-"))
    if new:
        layout = "route string, batch string"
        rows = spark.read.schema(layout).option("basePath", store).parquet(*[f"{store}/{b}" for b in new])
        rows.distinct().write.mode("append").partitionBy("batch").parquet(seeds)


def ingest_pages(pages: DataFrame, store: str, state: str) -> StreamingQuery:
    """Store arriving pages once per route; ``pages`` is a stream of (page_id, url, html).

    Which routes are stored is keyed state, one value per route, so a batch costs what arrives in
    it, however large the store is. When the query starts, routes that other queries have stored
    since this state last learned of them arrive first, as rows of their own; the store is not read
    again. Pages that two queries take at the same time may both be stored. Each batch of each
    state folder owns one folder of the store, which a repeated batch overwrites.
    """
    spark = pages.sparkSession
    own = hashlib.md5(state.encode()).hexdigest()[:16]
    seeds = f"{state}-routes"
    seed_routes(spark, store, seeds, own)
    known = stream_table(spark, seeds, T.StructType.fromDDL("route string, batch string"), "*.parquet")
    nothing = F.lit(None).cast("string")

    def keyed(route: Column) -> Column:
        # Never NULL on either side: a state's key keeps its type when one side is empty.
        return F.coalesce(route, F.lit(NO_ROUTE)).alias("route")

    stored = known.select(
        keyed(F.col("route")), F.lit(True).alias("known"), F.lit(0).cast("bigint").alias("page_id"), F.lit(False).alias("named"), nothing.alias("url"), nothing.alias("html")
    )
    # Ids stay whole numbers on their way through pandas: a missing one is the smallest.
    arrived = pages.select(
        keyed(route_of(F.col("url"))),
        F.lit(False).alias("known"),
        F.coalesce(F.col("page_id").cast("bigint"), F.lit(-(1 << 63))).alias("page_id"),
        F.col("page_id").isNotNull().alias("named"),
        "url",
        "html",
    )
    first = (
        arrived.unionByName(stored)
        .groupBy("route")
        .applyInPandasWithState(
            first_pages, "route string, page_id bigint, named boolean, url string, html string", "seen boolean", "append", GroupStateTimeout.NoTimeout
        )
    )

    def save(batch: DataFrame, batch_id: int) -> None:
        route = F.nullif(F.col("route"), F.lit(NO_ROUTE)).alias("route")
        rows = batch.select(F.when(F.col("named"), F.col("page_id")).alias("page_id"), "url", "html", route)
        rows.write.mode("overwrite").parquet(f"{store}/batch={own}-{batch_id}")

    with settings(spark, spark__sql__streaming__stateStore__providerClass=STATE_STORE):
        return (
            first.writeStream.foreachBatch(save)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
