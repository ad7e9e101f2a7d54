"""Time-based jobs on request logs: cache hits, sessions, rate limits, retries.

A key may own a large share of all requests, so no job sorts a whole key in one task. Requests
are first reduced to slots of (key, time bucket), which is a partial aggregation; what is
ordered per key afterwards is one row per slot, bounded by the calendar instead of the traffic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.session import cut_lineage

TTL_MS = 3_600_000
CAPACITY = 5
RATE = 1.0
# Spans in which a key's requests are folded, each about a thousand of the one before.
SPANS_MS = (1_000, 1_000_000, 1_000_000_000)
RUN = 4096  # slots that are ordered in one task
SPLITS = 16  # time buckets in a time to live, for joins as of a time


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def _slots(requests: DataFrame, key: str, ts: str, row_id: str, gap_ms: int) -> DataFrame:
    """One row per key and bucket of the gap's width, with its first and last request.

    Requests of one bucket are closer together than the gap, so only the first one of a bucket
    can come later than the gap after its predecessor, which then is the last of the bucket
    before.
    """
    timed = requests.select(key, _ms(F.col(ts)).alias("_ms"), row_id)
    # Written once: the log is scanned for it, and both sides of the join read it.
    slots = cut_lineage(
        timed.groupBy(key, F.floor(F.col("_ms") / gap_ms).alias("slot")).agg(
            F.min(F.struct("_ms", row_id)).alias("first"),
            F.max("_ms").alias("last_ms"),
            F.count("*").alias("n"),
        )
    )
    before = slots.select(
        key, (F.col("slot") + 1).alias("slot"), F.col("last_ms").alias("before_ms")
    )
    linked = slots.join(before, [key, "slot"], "left")
    gap = F.col("first._ms") - F.col("before_ms")
    return linked.withColumn("opens", F.coalesce(gap > gap_ms, F.lit(True)))


def cache_hits(
    requests: DataFrame, key: str, ts: str, row_id: str, ttl_ms: int = TTL_MS
) -> DataFrame:
    """Add ``hit``: the key was requested within the time to live before; reads renew it."""
    slots = _slots(requests, key, ts, row_id, ttl_ms)
    misses = slots.filter("opens").select(
        F.col("first")[row_id].alias(row_id), F.lit(False).alias("_hit")
    )
    return (
        requests.join(misses, row_id, "left")
        .withColumn("hit", F.coalesce("_hit", F.lit(True)))
        .drop("_hit")
    )


def reuse_asof(
    requests: DataFrame,
    snapshots: DataFrame,
    key: str,
    ts: str,
    snapshot_id: str,
    ttl_ms: int = TTL_MS,
    splits: int = SPLITS,
) -> DataFrame:
    """Add the snapshot of the key that was the latest at the time of each request, and its age.

    ``snapshots`` is (key, ts, snapshot_id); of several at one time the largest id counts, and one
    stored at the very time of a request is there for it. A snapshot serves for less than the time
    to live; requests without one have NULL in ``snapshot_id`` and ``age_ms``.

    Time is cut into buckets of a part of the time to live. The last snapshot of a bucket is
    carried to the buckets in which it may still serve; the rest happens within (key, bucket), so
    a key with most of the requests is spread over its buckets, and every row moves once.
    """
    width = max(1, -(-ttl_ms // splits))
    bucket = F.floor(F.col("_ms") / width)
    columns = [c for c in requests.columns if c not in (snapshot_id, "age_ms")]
    asked = requests.select(
        F.col(key).alias("_key"), _ms(F.col(ts)).alias("_ms"), F.lit(None).alias("_shot"), F.struct(*columns).alias("_row")
    ).withColumn("_bucket", bucket)
    shots = snapshots.select(F.col(key).alias("_key"), _ms(F.col(ts)).alias("_ms"), F.col(snapshot_id).alias("_id"))
    shots = shots.filter("_key IS NOT NULL AND _ms IS NOT NULL")
    shots = shots.withColumn("_bucket", bucket).groupBy("_key", "_bucket", "_ms").agg(F.max("_id").alias("_id"))
    shots = shots.select("_key", "_ms", F.struct("_ms", "_id").alias("_shot"), "_bucket")
    last = shots.groupBy("_key", "_bucket").agg(F.max("_shot").alias("_shot"))
    reach = -(-ttl_ms // width)
    carried = (
        last.select("_key", F.explode(F.sequence(F.col("_bucket") + 1, F.col("_bucket") + reach)).alias("_bucket"), "_shot")
        .groupBy("_key", "_bucket")
        .agg(F.max("_shot").alias("_shot"))
        .select("_key", F.col("_shot._ms").alias("_ms"), "_shot", "_bucket")
    )
    none = F.lit(None).cast(asked.schema["_row"].dataType).alias("_row")
    asked = asked.withColumn("_shot", F.lit(None).cast(shots.schema["_shot"].dataType))
    both = asked.unionByName(shots.unionByName(carried).select("*", none))
    order = Window.partitionBy("_key", "_bucket").orderBy("_ms", F.col("_row").isNotNull())
    seen = both.withColumn("_last", F.last("_shot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    age = F.col("_ms") - F.col("_last._ms")
    found = seen.filter("_row IS NOT NULL").withColumn("_age", F.when(age < ttl_ms, age))
    return found.select(
        "_row.*", F.when(F.col("_age").isNotNull(), F.col("_last._id")).alias(snapshot_id), F.col("_age").alias("age_ms")
    )


def cache_sessions(
    requests: DataFrame, key: str, ts: str, row_id: str, ttl_ms: int = TTL_MS
) -> DataFrame:
    """(key, start_ms, end_ms, n_requests) of runs of requests no further apart than the TTL."""
    slots = _slots(requests, key, ts, row_id, ttl_ms).withColumn("_run", F.floor(F.col("slot") / RUN))
    # Sessions are numbered within runs of slots; what runs before hold is added to them, so no
    # task orders all slots of a key.
    opened = F.sum(F.col("opens").cast("bigint"))
    so_far = Window.partitionBy(key, "_run").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = slots.groupBy(key, "_run").agg(opened.alias("_opened"))
    offsets = runs.select(key, "_run", F.coalesce(F.sum("_opened").over(earlier), F.lit(0)).alias("_before"))
    numbered = slots.withColumn("_own", opened.over(so_far)).join(offsets, [key, "_run"])
    numbered = numbered.withColumn("_session", F.col("_own") + F.col("_before"))
    return (
        numbered.groupBy(key, "_session")
        .agg(
            F.min("first._ms").alias("start_ms"),
            F.max("last_ms").alias("end_ms"),
            F.sum("n").alias("n_requests"),
        )
        .drop("_session")
    )


def rate_audit(
    requests: DataFrame,
    key: str,
    ts: str,
    limit: int,
    width: str = "1 minute",
    slide: str | None = None,
) -> DataFrame:
    """Windows in which a key made more than ``limit`` requests; also for streams."""
    window = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    counts = requests.groupBy(F.col(key), window.alias("_window")).agg(
        F.count("*").alias("n_requests")
    )
    return counts.filter(F.col("n_requests") > limit).select(
        key,
        _ms(F.col("_window.start")).alias("start_ms"),
        _ms(F.col("_window.end")).alias("end_ms"),
        "n_requests",
    )


def _clamp(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def _struct(**fields: Column) -> Column:
    return F.struct(*(value.alias(name) for name, value in fields.items()))


class _Bucket:
    """Column arithmetic of one token bucket.

    What a run of requests does to the token count x is always clamp(x + a, low, high), and such
    steps compose to the same shape. A step also keeps its first and last time, so that the
    refill between two steps can be put in when they are joined.
    """

    def __init__(self, capacity: int, rate: float):
        self.full = F.lit(capacity).cast("bigint")
        self.zero = F.lit(0).cast("bigint")
        self.rate = rate

    def refill(self, elapsed: Column) -> Column:
        """Tokens gained in ``elapsed`` ms; none when there was no request before."""
        gained = F.floor(elapsed * F.lit(float(self.rate)) / F.lit(1000.0)).cast("bigint")
        return F.least(F.coalesce(gained, self.zero), self.full)

    def start(self) -> Column:
        """The step that changes nothing; its times are not known yet."""
        no_time = F.lit(None).cast("bigint")
        return _struct(
            first_ms=no_time, last_ms=no_time, a=self.zero, low=self.zero, high=self.full
        )

    def then(self, f: Column, g: Column) -> Column:
        """``f``, the refill up to the first request of ``g``, then ``g``."""
        gained = self.refill(g["first_ms"] - f["last_ms"])
        low = F.least(f["low"] + gained, self.full)
        high = F.least(f["high"] + gained, self.full)
        return _struct(
            first_ms=F.coalesce(f["first_ms"], g["first_ms"]),
            last_ms=g["last_ms"],
            a=f["a"] + gained + g["a"],
            low=_clamp(low + g["a"], g["low"], g["high"]),
            high=_clamp(high + g["a"], g["low"], g["high"]),
        )

    def tick(self, f: Column, t: Column) -> Column:
        """``f`` followed by ``n`` requests in one millisecond."""
        asked = _struct(
            first_ms=t["ms"],
            last_ms=t["ms"],
            a=-t["n"],
            low=self.zero,
            high=F.greatest(self.full - t["n"], self.zero),
        )
        return self.then(f, asked)

    def have(self, acc: Column, first_ms: Column) -> Column:
        """Tokens at ``first_ms``, refilled since the time of ``acc``."""
        gained = self.refill(first_ms - acc["ms"])
        return F.least(acc["x"] + gained, self.full)

    def starts(self, steps: Column, order: str, x: Column) -> Column:
        """Token count at the first request of each of the consecutive ``steps``."""

        def follow(acc: Column, s: Column) -> Column:
            have = self.have(acc, s["step"]["first_ms"])
            row = _struct(**{order: s[order], "start": have})
            return _struct(
                x=_clamp(have + s["step"]["a"], s["step"]["low"], s["step"]["high"]),
                ms=s["step"]["last_ms"],
                out=F.concat(acc["out"], F.array(row)),
            )

        empty = F.array().cast(f"array<struct<{order}: bigint, start: bigint>>")
        first = _struct(x=x, ms=F.lit(None).cast("bigint"), out=empty)
        return F.aggregate(steps, first, follow)["out"]

    def replay(self, ticks: Column, x: Column) -> Column:
        """How many requests of each millisecond find a token."""

        def follow(acc: Column, t: Column) -> Column:
            have = self.have(acc, t["ms"])
            taken = F.least(have, t["n"])
            return _struct(
                x=have - taken,
                ms=t["ms"],
                out=F.concat(acc["out"], F.array(_struct(_ms=t["ms"], _taken=taken))),
            )

        empty = F.array().cast("array<struct<_ms: bigint, _taken: bigint>>")
        first = _struct(x=x, ms=F.lit(None).cast("bigint"), out=empty)
        return F.aggregate(ticks, first, follow)["out"]


def throttle_events(
    requests: DataFrame,
    key: str,
    ts: str,
    row_id: str,
    capacity: int = CAPACITY,
    rate: float = RATE,
) -> DataFrame:
    """Add ``admitted``: would a token bucket per key have let the request through at once?

    Every request first refills ``floor(elapsed_ms * rate / 1000)`` tokens (up to ``capacity``)
    and restarts the clock, so fractions are lost; a request that finds no token takes none.

    Requests are counted per millisecond and folded span by span, each a thousand times longer;
    then the token counts flow back down, and the shortest spans are replayed. No task folds more
    than about a thousand steps, or a row per long span of a key.
    """
    bucket = _Bucket(capacity, rate)
    timed = requests.select(key, row_id, _ms(F.col(ts)).alias("_ms"))

    ticks = timed.groupBy(key, "_ms").agg(F.count("*").alias("n"))
    first, *longer = SPANS_MS
    levels = [
        cut_lineage(
            ticks.groupBy(key, F.floor(F.col("_ms") / first).alias("span")).agg(
                F.array_sort(F.collect_list(_struct(ms=F.col("_ms"), n=F.col("n")))).alias("steps")
            )
        )
    ]
    folded = levels[0].select(
        key, "span", F.aggregate("steps", bucket.start(), bucket.tick).alias("step")
    )
    joined = F.aggregate("steps", bucket.start(), lambda f, s: bucket.then(f, s["step"]))
    for shorter, width in zip(SPANS_MS, longer):
        parent = F.floor(F.col("span") * shorter / width)
        levels.append(
            cut_lineage(
                folded.groupBy(key, parent.alias("parent"))
                .agg(F.array_sort(F.collect_list(F.struct("span", "step"))).alias("steps"))
                .withColumnRenamed("parent", "span")
            )
        )
        folded = levels[-1].select(key, "span", joined.alias("step"))
    starts = (
        folded.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("span", "step"))).alias("steps"))
        .select(key, F.inline(bucket.starts(F.col("steps"), "span", bucket.full)))
    )
    for level in reversed(levels[1:]):
        starts = level.join(starts, [key, "span"]).select(
            key, F.inline(bucket.starts(F.col("steps"), "span", F.col("start")))
        )
    taken = (
        levels[0]
        .join(starts, [key, "span"])
        .select(key, F.inline(bucket.replay(F.col("steps"), F.col("start"))))
        .filter("_taken > 0")
    )

    # The first of them by id; the rank limit trims each group before the shuffle.
    rank = F.row_number().over(Window.partitionBy(key, "_ms").orderBy(row_id))
    leading = timed.withColumn("_rank", rank).filter(F.col("_rank") <= capacity)
    admitted = (
        leading.join(taken, [key, "_ms"])
        .filter("_rank <= _taken")
        .select(row_id, F.lit(True).alias("_admitted"))
    )
    return (
        requests.join(admitted, row_id, "left")
        .withColumn("admitted", F.coalesce("_admitted", F.lit(False)))
        .drop("_admitted")
    )


def retry_schedule(
    failures: DataFrame,
    error: str,
    attempt: str,
    failed_at_ms: str,
    base_ms: int = 1000,
    retries: int = 3,
    step_ms: int = 1000,
    attempts: int = 3,
) -> DataFrame:
    """Failures that are tried again, with the wait and the due time.

    ``attempt`` counts the failed tries so far. Errors with 429 wait ``base_ms`` doubled per
    try, for ``retries`` retries; others wait ``step_ms`` per try until ``attempts`` tries failed.
    """
    n = F.col(attempt)
    limited = F.coalesce(F.col(error).contains("429"), F.lit(False))
    again = F.when(limited, n <= retries).otherwise(n < attempts)
    doubled = (F.lit(base_ms) * F.pow(F.lit(2), n - 1)).cast("bigint")
    wait = F.when(limited, doubled).otherwise((F.lit(step_ms) * n).cast("bigint"))
    return (
        failures.filter(again)
        .withColumn("backoff", F.when(limited, "exponential").otherwise("linear"))
        .withColumn("wait_ms", wait)
        .withColumn("due_ms", F.col(failed_at_ms) + F.col("wait_ms"))
    )
