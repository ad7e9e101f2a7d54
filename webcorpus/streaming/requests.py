"""Rate limits, sessions and de-duplication on a stream of requests."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webcorpus.operators import rates

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SENT = 100_000  # milliseconds sent back at once


class TokenBucket(StatefulProcessor):
    """Counts admitted requests per key and millisecond, in event-time order.

    What arrives are milliseconds that the watermark has closed: none of them comes again, and those
    of a later batch lie after them. So a batch is sorted and replayed, and only the bucket is state.
    """

    def __init__(self, capacity: int, rate: float):
        self.capacity, self.rate = capacity, rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens bigint, last_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = [(batch["ms"].to_numpy(), batch["n"].to_numpy()) for batch in rows]
        ms, counts = (np.concatenate(column) for column in zip(*closed))
        order = np.argsort(ms, kind="stable")
        ms, counts = ms[order], counts[order]
        tokens, last = self.bucket.get() if self.bucket.exists() else (self.capacity, None)
        for low in range(0, len(ms), SENT):
            at, n = ms[low : low + SENT], counts[low : low + SENT]
            admitted = []
            for now, wanted in zip(at.tolist(), n.tolist()):
                if last is not None:
                    gained = max(0, math.floor((now - last) * self.rate / 1000))
                    tokens = min(self.capacity, tokens + gained)
                taken = min(tokens, wanted)
                tokens, last = tokens - taken, now
                admitted.append(taken)
            if low + SENT >= len(ms):
                self.bucket.update((tokens, last))
            yield pd.DataFrame({"key": key[0], "ms": at, "n_requests": n, "n_admitted": admitted})

    def close(self) -> None:
        pass


def throttle_stream(
    requests: DataFrame,
    key: str,
    ts: str,
    delay: str = "1 minute",
    capacity: int = rates.CAPACITY,
    rate: float = rates.RATE,
) -> DataFrame:
    """(key, ms, n_requests, n_admitted) from a stream; needs the RocksDB state store.

    Requests are counted per key and millisecond by Spark's own partial aggregation first, so a
    key with most of the traffic sends counts instead of requests; a millisecond is counted when
    the watermark has passed it, and the buckets replay closed milliseconds in order.
    """
    timed = requests.select(
        F.col(key).cast("string").alias("key"), F.date_trunc("millisecond", F.col(ts)).alias("at")
    )
    window = F.window("at", "1 millisecond")
    counted = (
        timed.withWatermark("at", delay)
        .groupBy("key", window)
        .agg(F.count("*").alias("n"))
        .select("key", F.unix_millis("window.start").alias("ms"), "n", F.window_time("window").alias("closed"))
    )
    watched = counted
    return watched.groupBy("key").transformWithStateInPandas(
        statefulProcessor=TokenBucket(capacity, rate),
        outputStructType="key string, ms bigint, n_requests bigint, n_admitted bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def rate_audit_stream(
    requests: DataFrame, key: str, ts: str, limit: int, width: str, delay: str = "1 minute"
) -> DataFrame:
    """Windows over the limit, emitted once the watermark has closed them."""
    return rates.rate_audit(requests.withWatermark(ts, delay), key, ts, limit, width)


def session_stream(
    requests: DataFrame, key: str, ts: str, gap: str = "1 hour", delay: str = "1 minute"
) -> DataFrame:
    """(key, start_ms, end_ms, n_requests) of closed sessions; ``end_ms`` is the last request.

    Sessions are merged within each input partition before they are shuffled.
    """
    sessions = (
        requests.withWatermark(ts, delay)
        .groupBy(F.session_window(ts, gap).alias("_window"), F.col(key))
        .agg(F.count("*").alias("n_requests"), F.max(F.unix_millis(ts)).alias("end_ms"))
    )
    return sessions.select(
        key, F.unix_millis("_window.start").alias("start_ms"), "end_ms", "n_requests"
    )


def dedup_stream(
    requests: DataFrame, key: str, ts: str, ttl_ms: int = rates.TTL_MS, delay: str = "1 minute"
) -> DataFrame:
    """(key, ms) of every request that finds nothing in a cache of this time to live.

    Reads renew the age, so these are the starts of the runs of requests no further apart than
    the TTL; a key is processed again after it. Runs are sessions in Spark's state, merged within
    each input partition before they are shuffled, and are emitted when the watermark closes them.
    """
    timed = requests.select(key, F.timestamp_millis(F.unix_millis(ts)).alias("_at"))
    runs = (
        timed.withWatermark("_at", delay)
        # Sessions that touch are one, so a request exactly one TTL later is still a hit.
        .groupBy(F.session_window("_at", f"{ttl_ms} milliseconds").alias("_run"), F.col(key))
        .agg(F.count("*").alias("n"))
    )
    return runs.select(key, F.unix_millis("_run.start").alias("ms"))
