from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webcorpus.operators import catalog, crawl, joins, layout, report, similar, summaries
from webcorpus.session import cut_lineage
from webcorpus.sources import readers, sinks

graphs = st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)), min_size=1, max_size=40)
SPARK = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.too_slow])


def edges(spark, pairs, names="src bigint, dst bigint"):
    return spark.createDataFrame(pairs, names)


def depths(pairs, seeds, bound):
    seen, level = {s: 0 for s in seeds}, set(seeds)
    for d in range(1, bound + 1):
        level = {b for a, b in pairs if a in level} - set(seen)
        seen.update(dict.fromkeys(level, d))
    return seen


@SPARK
@given(graphs, st.integers(0, 4))
def test_bfs_matches_brute_force(spark, pairs, bound):
    seeds = spark.createDataFrame([(0,), (0,), (7,)], "node bigint")
    found = crawl.crawl_bfs(edges(spark, pairs), seeds, bound).collect()
    assert {r.node: r.depth for r in found} == depths(pairs, {0, 7}, bound)
    assert len(found) == len({r.node for r in found})


def test_bfs_follows_only_expandable_nodes(spark):
    seeds = spark.createDataFrame([(0,)], "node bigint")
    expand = spark.createDataFrame([(0,), (2,)], "node bigint")
    found = crawl.crawl_bfs(edges(spark, [(0, 1), (0, 2), (1, 3), (2, 4), (4, 5)]), seeds, 5, expand)
    assert {r.node: r.depth for r in found.collect()} == {0: 0, 1: 1, 2: 1, 4: 2}


def test_hub_pages_take_the_shuffled_path(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 10)
    pairs = [(0, i) for i in range(1, 400)] + [(i, 0) for i in range(1, 400)] + [(5, 1000)]
    seeds = spark.createDataFrame([(0,)], "node bigint")
    found = crawl.crawl_bfs(edges(spark, pairs), seeds, 2).collect()
    assert {r.node: r.depth for r in found} == depths(pairs, {0}, 2)


def test_routes_are_fetched_once(spark):
    nodes = spark.createDataFrame(
        [
            (0, "home", "ok"), (1, "a", "ok"), (2, "a", "ok"), (3, "b", "failed"),
            (4, "c", "no_content"), (5, "x", "ok"), (6, "y", "ok"), (7, "z", "ok"), (8, "b", "ok"),
            (9, "old", "ok"), (10, "w", "ok"),
        ],
        "node bigint, route string, status string",
    )
    links = edges(
        spark, [(0, 1), (0, 2), (0, 3), (0, 4), (0, 9), (2, 5), (3, 6), (4, 7), (1, 8), (9, 10)]
    )
    seeds = spark.createDataFrame([(0,)], "node bigint")
    stored = spark.createDataFrame([("old",)], "route string")

    def run(**options):
        rows = crawl.crawl_routes(links, seeds, nodes, 3, stored, **options).collect()
        return {r.node: (r.depth, r.outcome) for r in rows}

    expected = {
        0: (0, "stored"), 1: (1, "stored"), 2: (1, "reused"), 3: (1, "failed"),
        4: (1, "no_content"), 9: (1, "reused"), 7: (2, "stored"), 8: (2, "stored"),
    }
    assert run() == expected
    assert run(expand_reused=True) == {**expected, 5: (2, "stored"), 10: (2, "stored")}


def test_lookup_join_paths_agree(spark):
    left = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k")
    )
    lookup = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("left", "inner", "left_anti", "left_semi"):
        expected = sorted(map(tuple, joins.lookup_join(left, lookup, "k", how).collect()), key=str)
        for hot_rows in (1, 1000, 10**6):
            split = joins.lookup_join(
                left, lookup, "k", how, spread_by="id", max_broadcast=0, hot_rows=hot_rows, settle=True
            )
            assert split.columns == joins.lookup_join(left, lookup, "k", how).columns
            assert sorted(map(tuple, split.collect()), key=str) == expected


def test_all_hot_keys_are_found(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("k"))
    assert joins.hot_keys(df, ["k"], 101).count() == 0
    assert joins.hot_keys(df, ["k"], 100).count() == 10
    assert joins.hot_keys(df, ["k"], 1).count() == 10


def test_reuse_and_dedup(spark):
    pages = spark.createDataFrame(
        [(1, "https://a.org/x.html"), (2, "https://b.org/x/"), (3, "https://a.org/y"), (4, "https://a.org")],
        "id bigint, url string",
    )
    stored = spark.createDataFrame([("y",), ("y",)], "route string")
    reused = crawl.reuse_existing(pages, stored, "id").orderBy("id").collect()
    assert [(r.route, r.reused) for r in reused] == [
        ("x", False), ("x", False), ("y", True), ("root", False),
    ]
    kept = crawl.route_dedup(pages, [F.desc("id")]).collect()
    assert {r.id for r in kept} == {2, 3, 4}


def test_group_limit_runs_before_the_shuffle(spark, capsys):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    crawl.firsts(df, ["g"], [F.col("id")]).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2


def results(spark, rows):
    schema = "id bigint, url string, error string, content_size bigint, found_links bigint, processing_ms bigint"
    return spark.createDataFrame(rows, schema)


def test_reports(spark, tmp_path):
    df = results(
        spark,
        [
            (1, "https://a.org/x", None, 1500, 3, 20),
            (2, "https://a.org/y", "429, quota", None, None, None),
            (3, "https://b.org/x", "", 0, 0, 0),
        ],
    )
    assert tuple(report.report_totals(df).first()) == (3, 2, 1)
    stats = report.crawl_stats(df).first()
    assert (round(stats.success_rate, 3), stats.total_size) == (66.667, 1500)
    assert round(stats.avg_processing_ms, 3) == 6.667
    assert tuple(report.crawl_stats(df.limit(0)).first()) == (None, None, None)
    table = report.results_table(df).orderBy("url").collect()
    assert [tuple(r)[1:] for r in table] == [
        ("Success", "1.5 kB", "20ms", "3"), ("Failed", "-", "-", "-"), ("Success", "0 B", "0ms", "0"),
    ]
    for fmt, expected in {
        "CSV": [
            "URL,Status,Content Size,Processing Time,Links Found,Error",
            "https://a.org/x,Success,1500,20,3,",
            "https://a.org/y,Failed,,,,429, quota",
            "https://b.org/x,Success,,,,",
        ],
        "markdown": [
            "URL|Status|Content Size|Processing Time|Links Found|Error",
            "---|---|---|---|---|---",
            "https://a.org/x|✅ Success|1.5 kB|20ms|3|-",
            "https://a.org/y|❌ Failed|-|-|-|429, quota",
            "https://b.org/x|✅ Success|-|-|-|-",
        ],
    }.items():
        path = str(tmp_path / fmt)
        sinks.export_results(df, fmt, path)
        assert sorted(r.value for r in spark.read.text(path).collect()) == sorted(expected)
    sinks.export_results(df, "json", str(tmp_path / "json"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect())
    assert lines[0].startswith('["https://a.org/x",{"url":"https://a.org/x","content_size":1500')
    try:
        sinks.export_results(df, "xml", str(tmp_path / "xml"))
        raise AssertionError("xml was accepted")
    except ValueError as error:
        assert "Unsupported export format" in str(error)
    sinks.export_quoted_csv(df, str(tmp_path / "quoted"))
    schema = df.schema
    again = spark.read.schema(schema).option("header", True).option("escape", '"').csv(str(tmp_path / "quoted"))
    assert {r.error for r in again.collect()} == {None, "429, quota"}
    sinks.save_report(report.crawl_report(df, "id"), str(tmp_path / "report"))
    saved = spark.read.text(str(tmp_path / "report"))
    assert {r.section: r["count"] for r in saved.groupBy("section").count().collect()} == {
        "totals": 1, "failed": 1, "route": 2,
    }


def test_long_url_lists_are_split(spark):
    df = spark.range(1000).select(
        "id", F.concat(F.lit("https://h"), "id", F.lit(".org/one")).alias("url")
    )
    lists = report.route_url_lists(df, "id", size=50).collect()
    assert sorted(u for r in lists for u in r.urls) == sorted(r.url for r in df.collect())
    assert len(lists) == 20 and max(len(r.urls) for r in lists) < 100


def test_store_keeps_what_is_there(spark, tmp_path):
    store = str(tmp_path / "store")
    pages = spark.createDataFrame(
        [
            (1, "https://a.org/x", "c1", ""), (2, "https://b.org/x", "c2", "p2"),
            (3, "https://a.org/y", "", ""),
        ],
        "id bigint, url string, content string, processed string",
    )
    sinks.save_content(sinks.new_content(pages, [F.col("id")], "id"), store)
    first = {(r.route, r.kind): r.body for r in spark.read.parquet(store).collect()}
    assert first == {("x", "content"): "c1", ("x", "processed"): "p2"}
    more = spark.createDataFrame(
        [(4, "https://c.org/x", "c4", "p4"), (5, "https://c.org/y", "c5", "p5")], pages.schema
    )
    new = sinks.new_content(more, [F.col("id")], "id", spark.read.parquet(store))
    sinks.save_content(new, store)
    second = {(r.route, r.kind): r.body for r in spark.read.parquet(store).collect()}
    assert second == {**first, ("y", "content"): "c5", ("y", "processed"): "p5"}


def test_readers(spark, tmp_path, sf):
    pages = readers.read_pages(spark, f"{sf}/pages.parquet").limit(5)
    for fmt in ("json", "csv", "orc"):
        pages.write.format(fmt).option("header", True).option("escape", '"').save(str(tmp_path / fmt))
        again = readers.read_pages(spark, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, again.collect())) == sorted(map(tuple, pages.collect()))
    for arguments in ({"fmt": "xml"}, {"fmt": "json"}):
        try:
            readers.read_table(spark, str(tmp_path), **arguments)
            raise AssertionError("accepted")
        except ValueError:
            pass


def test_latest_version(spark):
    names = ["m-2.5-flash-05", "m-2-flash-001", "models/m-10.1-flash-pro", "flash", "models/m-2.5-flash"]
    df = spark.createDataFrame([("f", i, n) for i, n in enumerate(names)] + [("g", 9, "pro")],
                               "family string, i bigint, name string")
    versions = [r.v for r in df.select("i", catalog.name_version(F.col("name")).alias("v")).orderBy("i").collect()]
    assert versions == [2.5, 2.001, 10.1, 0.0, 2.5, 0.0]
    latest = {r.family: r.latest for r in catalog.latest_version(df, "family", "name", "i").collect()}
    assert latest == {"f": "m-2.5-flash-05", "g": catalog.DEFAULT_NAME}


def components(pairs):
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


@SPARK
@given(graphs)
def test_components_match_brute_force(spark, pairs):
    found = similar.connected_components(edges(spark, pairs, "a bigint, b bigint")).collect()
    expected = {n: c for n, c in components(pairs).items() if any(n in p and p[0] != p[1] for p in pairs)}
    assert {r.node: r.component for r in found} == expected


def test_summaries_merge_to_a_recount(spark, tmp_path):
    rows = [(i, f"https://a.org/p{i % 700}", "x" if i % 9 == 0 else None, (i * 37) % 1009, i % 50 or None) for i in range(6000)]
    results = spark.createDataFrame(rows, "doc_id bigint, url string, error string, content_size bigint, processing_ms bigint")
    store = str(tmp_path / "runs")
    assert summaries.report(summaries.summaries(spark, store)).first()[:3] == (0, 0, 0)
    for run, low, high in (("a", 0, 1000), ("b", 1000, 6000), ("c", 0, 0), ("b", 1000, 6000)):
        summaries.add_run(results.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high)), run, store)
    found = summaries.report(summaries.summaries(spark, store), (0.0, 0.25, 0.5, 1.0)).first()
    whole = report.report_totals(results).crossJoin(report.crawl_stats(results)).first()
    assert (found.total, found.successful, found.failed, found.total_size) == (whole.total, whole.successful, whole.failed, whole.total_size)
    assert abs(found.success_rate - whole.success_rate) < 1e-9 and abs(found.avg_processing_ms - whole.avg_processing_ms) < 1e-9
    assert abs(found.routes - 700) <= 0.04 * 700
    sizes = sorted(r[3] for r in rows)
    for q, value in zip((0.0, 0.25, 0.5, 1.0), found.size_quantiles):
        assert sizes[max(0, int((q - 0.03) * 6000))] <= value <= sizes[min(5999, int((q + 0.03) * 6000))]


def moved(frame, column):
    """Exchanges by a column in the plan, and whether a bucketed table is read in it."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count(f"Exchange hashpartitioning({column}#"), "Bucketed: true" in plan


def test_levels_move_neither_links_nor_visited_nodes(spark, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    pairs = [(i % 50, (i * 7) % 60) for i in range(400)]
    graph = layout.LinkGraph(edges(spark, pairs, "src bigint, dst bigint"))
    sources = cut_lineage(spark.createDataFrame([(i,) for i in range(5)], "node bigint"))
    reached = graph.targets(sources)
    assert moved(reached, "src") == (1, True)  # the sources
    seen = layout.Visited()
    seen.add(sources, 40)
    for _ in range(2):
        fresh = seen.unseen(cut_lineage(reached))
        assert moved(fresh, "node") == (1, True)  # what was reached
        fresh = cut_lineage(fresh)
        seen.add(fresh, 8)
        found = {r.node for r in fresh.collect()}
        assert found == {d for s, d in pairs if s < 5} - set(range(5)) or not found
    assert {r.node for r in seen.whole.collect()} >= set(range(5))


def test_a_laid_out_table_grows_by_appends(spark):
    table = layout.Bucketed(spark, ["k"], 8)
    table.append(spark.range(100).select((F.col("id") % 10).alias("k"), "id"))
    whole = table.append(spark.range(100, 150).select((F.col("id") % 10).alias("k"), "id"))
    assert whole.count() == 150
    assert moved(whole.groupBy("k").count(), "k") == (0, True)
    assert {r["count"] for r in whole.groupBy("k").count().collect()} == {15}


def test_similar_vectors_match_brute_force(spark, sf):
    import numpy as np

    from webcorpus.plans import derived

    vectors = derived.vectors(spark, sf)
    zero = spark.createDataFrame([(-1, [0.0] * 64)], "vec_id bigint, embedding array<double>")
    copies = vectors.filter("vec_id < 20").withColumn("vec_id", F.col("vec_id") + 100_000)
    vectors = vectors.union(zero).union(copies)
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect()}
    found = {r.vec_id: r.cluster for r in similar.cosine_dedup(vectors, "vec_id", "embedding").collect()}
    ids = sorted(i for i in rows if i >= 0)
    units = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    close = np.argwhere(units @ units.T >= 0.9)
    expected = components([(ids[a], ids[b]) for a, b in close])
    assert found == {**expected, -1: -1}
    assert found[100_000] == 0 and found[1] == 0
