import datetime as dt
import math
import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from webcorpus.operators import rates
from webcorpus.plans.registry import QUERIES
from webcorpus.streaming import ingest, requests as live

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SPARK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])


def log(spark, rows):
    """rows of (id, key, ms since the start)"""
    data = [(i, k, START + dt.timedelta(milliseconds=ms)) for i, k, ms in rows]
    return spark.createDataFrame(data, "id bigint, k string, ts timestamp")


def bucket(rows, capacity, rate):
    """Token bucket one request at a time."""
    state, out = {}, {}
    for i, k, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        tokens, last = state.get(k, (capacity, ms))
        tokens = min(capacity, tokens + int((ms - last) * rate // 1000))
        out[i] = tokens > 0
        state[k] = (tokens - out[i], ms)
    return out


logs = st.lists(
    st.tuples(st.sampled_from("ab"), st.sampled_from([0, 1, 300, 900, 1000, 2500, 11_000, 4_000_000])),
    min_size=1,
    max_size=60,
).map(
    lambda steps: [
        (n, k, sum(s for _, s in steps[: n + 1])) for n, (k, _) in enumerate(steps)
    ]
)


@SPARK
@given(logs, st.sampled_from([(5, 1.0), (1, 0.5), (3, 4.0)]))
def test_throttle_matches_one_by_one(spark, rows, settings_):
    capacity, rate = settings_
    marked = rates.throttle_events(log(spark, rows), "k", "ts", "id", capacity, rate).collect()
    assert {r.id: r.admitted for r in marked} == bucket(rows, capacity, rate)


def test_throttle_with_one_hot_key(spark):
    rows = [(i, "hot", (i // 40) * 700) for i in range(4000)] + [(9000 + i, f"k{i}", i) for i in range(50)]
    marked = rates.throttle_events(log(spark, rows), "k", "ts", "id").collect()
    assert {r.id: r.admitted for r in marked} == bucket(rows, 5, 1.0)


def hits(rows, ttl):
    last, out = {}, {}
    for i, k, ms in sorted(rows, key=lambda r: (r[2], r[0])):
        out[i] = k in last and ms - last[k] <= ttl
        last[k] = ms
    return out


@SPARK
@given(logs, st.sampled_from([1000, 3_600_000]))
def test_cache_hits_and_sessions_match_one_by_one(spark, rows, ttl):
    requests = log(spark, rows)
    marked = rates.cache_hits(requests, "k", "ts", "id", ttl).collect()
    expected = hits(rows, ttl)
    assert {r.id: r.hit for r in marked} == expected
    sessions = rates.cache_sessions(requests, "k", "ts", "id", ttl).collect()
    assert sum(r.n_requests for r in sessions) == len(rows)
    assert len(sessions) == list(expected.values()).count(False)


def test_reads_renew_the_age(spark):
    minute = 60_000
    requests = log(spark, [(1, "a", 0), (2, "a", 50 * minute), (3, "a", 100 * minute), (4, "a", 161 * minute)])
    marked = rates.cache_hits(requests, "k", "ts", "id", 60 * minute).orderBy("id").collect()
    assert [r.hit for r in marked] == [False, True, True, False]


def test_retries(spark):
    failures = spark.createDataFrame(
        [(i, e, a, 0) for i, (e, a) in enumerate([(e, a) for e in ("HTTP 429", "x", None) for a in range(1, 5)])],
        "i int, error string, attempt int, at bigint",
    )
    due = rates.retry_schedule(failures, "error", "attempt", "at").collect()
    assert [(r.error, r.attempt, r.wait_ms) for r in sorted(due, key=lambda r: r.i)] == [
        ("HTTP 429", 1, 1000), ("HTTP 429", 2, 2000), ("HTTP 429", 3, 4000),
        ("x", 1, 1000), ("x", 2, 2000), (None, 1, 1000), (None, 2, 2000),
    ]


def test_rate_audit(spark):
    requests = log(spark, [(i, "a", i * 10_000) for i in range(12)])
    assert [r.n_requests for r in rates.rate_audit(requests, "k", "ts", 5).collect()] == [6, 6]
    assert rates.rate_audit(requests, "k", "ts", 6).count() == 0


@pytest.fixture
def arrivals(spark, tmp_path):
    """A folder that receives one parquet file per batch of rows."""

    def write(batches):
        for n, rows in enumerate(batches):
            log(spark, rows).coalesce(1).write.parquet(str(tmp_path / "in" / f"{n}"))
        schema = "id bigint, k string, ts timestamp"
        return (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", True)
            .parquet(str(tmp_path / "in"))
        )

    return write


def test_stream_throttle_sorts_late_requests(spark, arrivals):
    rows = [(i, "ab"[i % 2], i * 400) for i in range(300)]
    swapped = rows[:100] + rows[130:200] + rows[100:130] + rows[200:]
    batches = [swapped[i : i + 75] for i in range(0, 300, 75)] + [[(999, "end", 10_000_000)]]
    out = ingest.drain(live.throttle_stream(arrivals(batches), "k", "ts", "1 minute", 2, 1.0), "t")
    expected = bucket(rows, 2, 1.0)
    got = {(r.key, r.ms - int(START.timestamp() * 1000)): (r.n_requests, r.n_admitted) for r in out.collect()}
    got.pop(("end", 10_000_000), None)
    assert got == {(k, ms): (1, int(expected[i])) for i, k, ms in rows}


def test_streams_match_their_batch_twins(spark, arrivals):
    minute = 60_000
    rows = [(i, "abc"[i % 3], (i * 37 % 500) * minute) for i in range(240)]
    rows.sort(key=lambda r: r[2])
    batches = [rows[i : i + 60] for i in range(0, 240, 60)] + [[(999, "end", 10**9)]]
    stream = arrivals(batches)
    whole = log(spark, rows)
    sessions = ingest.drain(live.session_stream(stream, "k", "ts", "20 minutes"), "s").collect()
    twin = rates.cache_sessions(whole, "k", "ts", "id", 20 * minute).collect()
    assert sorted(map(tuple, sessions)) == sorted(map(tuple, twin))
    audit = ingest.drain(live.rate_audit_stream(stream, "k", "ts", 9, "1 hour"), "a").collect()
    assert audit
    assert sorted(map(tuple, audit)) == sorted(
        map(tuple, rates.rate_audit(whole, "k", "ts", 9, "1 hour").collect())
    )


def test_stream_dedup_has_an_exact_ttl(spark, arrivals):
    minute = 60_000
    rows = [(1, "a", 0), (2, "a", 10 * minute), (3, "a", 20 * minute), (4, "b", 25 * minute), (5, "a", 30 * minute + 1), (6, "a", 50 * minute)]
    batches = [rows[:3], rows[3:], [(9, "end", 10**9)]]
    out = ingest.drain(live.dedup_stream(arrivals(batches), "k", "ts", 10 * minute), "d")
    start = int(START.timestamp() * 1000)
    expected = {(k, ms) for i, k, ms in rows if not hits(rows, 10 * minute)[i]}
    assert {(r.k, r.ms - start) for r in out.collect()} == expected


def test_closed_milliseconds_are_replayed_as_they_arrive():
    """A million of one key, unsorted and in two batches, with the bucket as the only state."""

    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return Value()

    rng = random.Random(3)
    counts = [(7 * i, rng.randint(1, 3)) for i in range(1_000_000)]
    processor, found = live.TokenBucket(5, 200.0), []
    processor.init(Handle())
    for batch in (counts[:400_000], counts[400_000:]):
        rng.shuffle(batch)
        parts = [pd.DataFrame(batch[at : at + 9_999], columns=["ms", "n"]) for at in range(0, len(batch), 9_999)]
        for out in processor.handleInputRows(("k",), iter(parts), None):
            assert len(out) <= live.SENT and set(out["key"]) == {"k"}
            found += zip(out["ms"].tolist(), out["n_requests"].tolist(), out["n_admitted"].tolist())
    tokens, last, expected = 5, 0, []
    for ms, n in sorted(counts[:400_000]) + sorted(counts[400_000:]):
        tokens = min(5, tokens + math.floor((ms - last) * 200.0 / 1000))
        expected.append((ms, n, min(tokens, n)))
        tokens, last = tokens - min(tokens, n), ms
    assert found == expected


def test_replay_leaves_nothing_in_the_state(spark, tmp_path):
    minute = 60_000
    rows = [(i, "abc"[i % 3], i * 7 * minute) for i in range(40)]
    whole = log(spark, rows)
    whole.coalesce(1).write.parquet(str(tmp_path / "log"))
    job = lambda s: live.session_stream(s, "k", "ts", "20 minutes")
    found = ingest.replay(spark, str(tmp_path / "log"), whole.schema, "*.parquet", "ts", job, "s")
    twin = rates.cache_sessions(whole, "k", "ts", "id", 20 * minute)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, twin.collect()))


def test_long_histories_fold_linearly(spark):
    import time

    seconds = []
    for n in (10_000, 40_000):
        requests = spark.range(n).select(
            F.col("id"), F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("ts")
        )
        begun = time.perf_counter()
        marked = rates.throttle_events(requests, "k", "ts", "id", 2, 1 / 3600)
        assert marked.filter("admitted").count() == n
        seconds.append(time.perf_counter() - begun)
    assert seconds[1] < 6 * seconds[0] + 2


def served(asked, shots, ttl):
    out = {}
    for i, k, ms in asked:
        before = [(m, n) for n, key, m in shots if key == k and m <= ms]
        m, n = max(before, default=(None, None))
        out[i] = (n, ms - m) if before and ms - m < ttl else (None, None)
    return out


@SPARK
@given(logs, logs, st.sampled_from([1, 700, 5_000, 10**7]), st.sampled_from([1, 3, 16]))
def test_reuse_as_of_matches_one_by_one(spark, asked, stored, ttl, splits):
    shots = log(spark, stored).select("k", "ts", F.col("id").alias("shot"))
    found = rates.reuse_asof(log(spark, asked).withColumn("shot", F.lit("own")), shots, "k", "ts", "shot", ttl, splits)
    assert found.columns == ["id", "k", "ts", "shot", "age_ms"]
    assert {r.id: (r.shot, r.age_ms) for r in found.collect()} == served(asked, stored, ttl)


def test_reuse_as_of_with_one_hot_key(spark):
    asked = [(i, "hot", i * 50) for i in range(3000)] + [(9000, None, 5)]
    stored = [(i, "hot", i * 9_000) for i in range(10)] + [(77, None, 1)]
    shots = log(spark, stored).select("k", "ts", F.col("id").alias("shot"))
    found = rates.reuse_asof(log(spark, asked), shots, "k", "ts", "shot", 8_000)
    expected = served([a for a in asked if a[1]], [x for x in stored if x[1]], 8_000)
    assert {r.id: (r.shot, r.age_ms) for r in found.collect()} == {**expected, 9000: (None, None)}
    # The key is spread over its time buckets.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key#" in plan and "_bucket#" in plan.split("hashpartitioning(_key#")[1][:40]


def test_sessions_run_across_runs_of_slots(spark, monkeypatch):
    monkeypatch.setattr(rates, "RUN", 4)
    rows = [(i, "ab"[i % 2], i * 400 + (i // 7) * 3_000) for i in range(200)]
    found = rates.cache_sessions(log(spark, rows), "k", "ts", "id", 1_000).collect()
    expected = []
    for key in "ab":
        runs = []
        for i, k, ms in rows:
            if k == key:
                if not runs or ms - runs[-1][1] > 1_000:
                    runs.append([ms, ms, 0])
                runs[-1][1:] = [ms, runs[-1][2] + 1]
        start = int(START.timestamp() * 1000)
        expected += [(key, start + a, start + b, n) for a, b, n in runs]
    assert sorted((r.k, r.start_ms, r.end_ms, r.n_requests) for r in found) == sorted(expected)


def test_ingest_stores_a_route_once(spark, tmp_path):
    schema = "page_id bigint, url string, html string"
    source, store = tmp_path / "pages", str(tmp_path / "store")

    def arrive(name, rows, state="state"):
        return sorted(arrive_all(name, rows, state))

    def arrive_all(name, rows, state="state"):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / name))
        pages = ingest.stream_table(spark, str(source / "*"), spark.createDataFrame([], schema).schema)
        ingest.ingest_pages(pages, store, str(tmp_path / state)).awaitTermination()
        return sorted((r.page_id for r in spark.read.parquet(store).collect()), key=str)

    assert arrive("1", [(2, "https://a.org/x", "h"), (1, "https://b.org/x", "h")]) == [1]
    assert arrive("2", [(3, "https://c.org/x/", "h"), (4, "https://c.org/y", "h")]) == [1, 4]
    # Another query with a state of its own adds to the store and takes nothing away.
    assert arrive("3", [(5, "https://d.org/z", "h"), (6, "https://a.org/x", "h")], "other") == [1, 4, 5]
    # What the other query stored is known to the first one when it goes on.
    assert arrive("4", [(8, "https://e.org/z", "h"), (7, "https://c.org/w", "h")]) == [1, 4, 5, 7]
    assert arrive("5", [(9, "https://c.org/w", "h")], "other") == [1, 4, 5, 7]
    # Odd pages: no id, no address, ids beyond what a double holds.
    big = 2**62 + 1
    found = arrive_all("6", [(None, "https://a.org/v", "h"), (big, "https://a.org/u", "h"), (big + 1, "https://b.org/u", "h"), (3, None, None)])
    assert found == sorted([1, 4, 5, 7, None, big, 3], key=str)


def test_given_tables_stream_from_one_file_or_a_folder(spark, tmp_path):
    pages = [(i, f"https://a.org/p{i % 7}", "h") for i in range(40)]
    events = [(i, "ab"[i % 2], i * 700) for i in range(60)]
    asked = log(spark, events).select(F.lit(1).alias("user_id"), F.col("k").alias("event_type"), "ts", F.col("id").alias("event_id"))
    found = []
    for name in ("folder", "file"):
        for table, rows in (("pages", spark.createDataFrame(pages, "page_id bigint, url string, html string")), ("events", asked)):
            parts = tmp_path / f"{name}-{table}"
            rows.repartition(3 if name == "folder" else 1).write.parquet(str(parts))
            at = tmp_path / name / f"{table}.parquet"
            at.parent.mkdir(exist_ok=True)
            (parts if name == "folder" else next(parts.glob("*.parquet"))).rename(at)
        found.append([sorted(map(tuple, QUERIES[q](spark, str(tmp_path / name)).collect())) for q in ("stream_ingest", "throttle_stream")])
    assert found[0] == found[1]
    assert len(found[0][0]) == 7 and sum(n for _, _, n, _ in found[0][1]) == 60


def test_ingest_costs_what_arrives(spark, tmp_path):
    """Many small batches over a growing store: the last take no longer than the first ones."""
    schema = "page_id bigint, url string, html string"
    source, store = str(tmp_path / "pages"), str(tmp_path / "store")
    for k in range(14):
        rows = [(1000 * k + i, f"https://a.org/p{500 * k + i}", "h") for i in range(1000)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k:02d}")
    pages = ingest.stream_table(spark, f"{source}/*", spark.createDataFrame([], schema).schema, files_per_trigger=1)
    query = ingest.ingest_pages(pages, store, str(tmp_path / "state"))
    query.awaitTermination()
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("route").distinct().count() == 13 * 500 + 1000
    seconds = [p["batchDuration"] / 1000 for p in query.recentProgress if p["numInputRows"]]
    assert len(seconds) == 14 and sum(seconds[-4:]) < 2 * sum(seconds[3:7])
