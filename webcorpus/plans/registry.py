"""Named queries over the given tables: (spark, sf_dir) -> DataFrame.

Arrays are shown as text and whole numbers as bigint, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions import text
from webcorpus.functions.sizes import pretty_bytes
from webcorpus.functions.urls import is_valid_url, route_of
from webcorpus.operators import (
    catalog,
    chunks,
    classify,
    crawl,
    extract,
    links,
    policy,
    rates,
    report,
    rules,
    similar,
    summaries,
    topics,
)
from webcorpus.plans import derived, pipeline
from webcorpus.plans.derived import derive, requests, table
from webcorpus.sources import readers, sinks
from webcorpus.streaming import ingest
from webcorpus.streaming import requests as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def _text(df: DataFrame, column: str, separator: str = "|") -> DataFrame:
    return df.withColumn(column, F.array_join(column, separator))


def _urls(spark, sf):
    return derive(spark, sf, derived.URLS)


def _texts(spark, sf):
    return derive(spark, sf, derived.TEXTS)


def _addressed(spark, sf):
    return derive(spark, sf, derived.ADDRESSED)


def _mixed(spark, sf):
    return _addressed(spark, sf).select(F.col("doc_id").alias("page_id"), "url", "html")


def _results(spark, sf):
    return derive(spark, sf, derived.RESULTS)


def _blocklist(spark, sf):
    return policy.load_blocklist(derive(spark, sf, derived.BLOCKLIST), "url")


def _lexicon(spark, sf):
    return derive(spark, sf, derived.LEXICON)


def _prior(spark, sf):
    return derive(spark, sf, derived.PRIOR).select(route_of(F.col("url")).alias("route"))


def _by_url():
    return [F.length("url").asc(), F.col("url").asc(), F.col("doc_id").asc()]


# Sources and sinks


@query
def scan_pages(spark, sf):
    return readers.scan_pages(readers.read_pages(spark, f"{sf}/pages.parquet"))


@query
def load_blocklist(spark, sf):
    return _blocklist(spark, sf)


@query
def reuse_existing(spark, sf):
    found = crawl.reuse_existing(_urls(spark, sf), _prior(spark, sf), "doc_id")
    return found.select("doc_id", "route", "reused")


@query
def sink_content(spark, sf):
    texts = _addressed(spark, sf).select("doc_id", "source", "url", F.col("text").alias("content"))
    pages = texts.withColumn(
        "processed", F.when(F.col("doc_id") % 4 == 0, "").otherwise(text.mask_phrases(F.col("content")))
    )
    stored = _prior(spark, sf).select("route", F.lit("content").alias("kind"))
    new = sinks.new_content(pages, _by_url(), "doc_id", stored)
    store = ingest.scratch(spark, "store")
    sinks.save_content(new, store)
    saved = spark.read.parquet(store)
    return saved.select("route", "kind", "url", F.md5("body").alias("body_md5"))


@query
def sink_content_rerun(spark, sf):
    """Routes and copies in a store that the same run was written to twice."""
    pages = _urls(spark, sf).join(
        table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "doc_id"
    ).withColumn("processed", F.lit(""))
    store = ingest.scratch(spark, "store")
    for _ in range(2):
        known = sinks.stored_routes(spark, store)
        sinks.save_content(sinks.new_content(pages, _by_url(), "doc_id", known), store)
    return spark.read.parquet(store).groupBy("route", "kind").agg(F.count("*").alias("n"))


@query
def export_json(spark, sf):
    return report.json_lines(_results(spark, sf))


@query
def export_csv(spark, sf):
    return report.csv_lines(_results(spark, sf))


@query
def export_markdown(spark, sf):
    return report.markdown_lines(_results(spark, sf))


@query
def crawl_report(spark, sf):
    return report.crawl_report(_results(spark, sf), "doc_id", size=10)


# Row selection


@query
def extract_links(spark, sf):
    return _long(links.extract_links(table(spark, sf, "pages")), "pos")


@query
def extract_links_mixed(spark, sf):
    return _long(links.extract_links(_mixed(spark, sf)), "pos")


@query
def same_site_links(spark, sf):
    return links.link_sites(_mixed(spark, sf))


@query
def textual_urls(spark, sf):
    return links.textual_urls(_urls(spark, sf)).select("doc_id", "url")


@query
def valid_urls(spark, sf):
    return links.valid_urls(derive(spark, sf, derived.RAW_URLS)).select("doc_id", "url")


@query
def restricted_urls(spark, sf):
    urls = _urls(spark, sf).select("doc_id", "url")
    pages = table(spark, sf, "pages").select((-F.col("page_id") - 1).alias("doc_id"), "url")
    return policy.flag_restricted(urls.union(pages), "url", _blocklist(spark, sf), "doc_id")


@query
def restricted_redirects(spark, sf):
    urls = _urls(spark, sf)
    last = urls.select((F.col("doc_id") + 1).alias("doc_id"), F.col("url").alias("final_url"))
    visits = urls.select("doc_id", "url").join(last, "doc_id", "left")
    return policy.restricted_redirects(visits, _blocklist(spark, sf), "doc_id", "url", "final_url")


@query
def credential_shapes(spark, sf):
    texts = table(spark, sf, "documents").withColumn(
        "text",
        F.when(
            F.col("doc_id") % 3 == 0, F.concat_ws(" ", "text", F.concat(F.lit("AIza_-0"), F.md5("text")))
        )
        .when(F.col("doc_id") % 3 == 1, F.concat_ws(" ", "text", F.concat(F.lit("AIza"), F.md5("text"))))
        .otherwise(F.col("text")),
    )
    return policy.credential_shapes(texts, "text", "source")


@query
def error_class(spark, sf):
    return policy.error_class(_results(spark, sf))


# Extraction


@query
def text_blocks(spark, sf):
    return _long(extract.text_blocks(table(spark, sf, "pages")), "pos")


@query
def code_blocks(spark, sf):
    return _long(extract.code_blocks(_mixed(spark, sf)), "pos")


@query
def code_languages(spark, sf):
    return extract.code_languages(extract.code_blocks(_mixed(spark, sf)))


@query
def clean_text(spark, sf):
    return _texts(spark, sf).select("doc_id", text.clean_text(F.col("text")).alias("text"))


@query
def dedup_blocks(spark, sf):
    return _long(extract.dedup_blocks(table(spark, sf, "pages")), "pos")


@query
def primary_content(spark, sf):
    return extract.primary_content(table(spark, sf, "pages"))


@query
def markdown_corpus(spark, sf):
    rows = _addressed(spark, sf).select("doc_id", "url", "text")
    title = F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("Page "), F.col("doc_id")))
    body = F.concat(F.lit("Heading One\n  \n"), F.col("text"))
    return rows.select(
        "doc_id",
        extract.markdown(body, F.col("url"), title, F.lit("2024-01-01T00:00:00.000Z")).alias(
            "markdown"
        ),
    )


# Policy, validation, classification


@query
def filter_text(spark, sf):
    return _texts(spark, sf).select("doc_id", text.mask_phrases(F.col("text")).alias("text"))


@query
def filter_text_all(spark, sf):
    return _texts(spark, sf).select("doc_id", text.mask_phrases(F.col("text"), False).alias("text"))


@query
def filter_text_array(spark, sf):
    parts = F.array(F.lit("xxx and xxx"), F.col("text"), F.lit("18+ only"))
    return _texts(spark, sf).select("doc_id", policy.mask_array(parts).alias("text"))


@query
def suspicious_flag(spark, sf):
    return _texts(spark, sf).select(
        "doc_id", policy.is_suspicious(F.col("text")).alias("suspicious")
    )


@query
def keyword_combo_flag(spark, sf):
    return _texts(spark, sf).select(
        "doc_id", policy.has_keyword_combination(F.col("text")).alias("combination")
    )


@query
def rule_matches(spark, sf):
    return rules.rule_matches(_texts(spark, sf), "doc_id", "text", derived.rules(spark, sf), "rule_id", "keywords")


@query
def sentiment_score(spark, sf):
    scores = policy.sentiment_scores(_texts(spark, sf), "doc_id", "text", _lexicon(spark, sf))
    return scores.withColumn("score", F.round("score", 8))


@query
def sentiment_stemmed(spark, sf):
    texts = _texts(spark, sf)
    lexicon = policy.stemmed_lexicon(texts, "text", derive(spark, sf, derived.ENGLISH))
    scores = policy.sentiment_scores(texts, "doc_id", "text", lexicon)
    return scores.withColumn("score", F.round("score", 8))


@query
def sentiment_flags(spark, sf):
    scores = policy.sentiment_scores(_texts(spark, sf), "doc_id", "text", _lexicon(spark, sf))
    return scores.select("doc_id", policy.sentiment_flag(F.col("score")).alias("flag"))


@query
def ai_verdicts(spark, sf):
    texts = _texts(spark, sf).select("doc_id", "source")
    joined = texts.join(derive(spark, sf, derived.VERDICTS), "doc_id", "left")
    return joined.select(
        "doc_id",
        policy.is_unsafe(F.col("verdict")).alias("unsafe"),
        policy.is_unsafe(F.col("verdict"), "ci").alias("unsafe_any_case"),
    )


def _validated(spark, sf):
    return policy.validate_content(
        _texts(spark, sf),
        "doc_id",
        "text",
        _blocklist(spark, sf),
        _lexicon(spark, sf),
        derive(spark, sf, derived.VERDICTS),
        keep=("source",),
    )


@query
def validate_content(spark, sf):
    return _text(_validated(spark, sf), "flags")


@query
def validation_counts(spark, sf):
    return policy.flag_counts(_validated(spark, sf), "source")


@query
def flag_reasons(spark, sf):
    combos = derive(spark, sf, derived.VERDICTS).select(
        "doc_id",
        F.array_compact(
            F.array(
                F.when(F.col("doc_id") % 2 == 0, "restricted_domain"),
                F.when(F.col("verdict") == "unsafe", "ai_safety_check"),
                F.when(F.col("doc_id") % 3 == 0, "unknown_flag"),
                F.when(F.col("doc_id") % 5 == 0, "validation_error"),
            )
        ).alias("flags"),
    )
    return combos.select("doc_id", policy.flag_reasons(F.col("flags")).alias("reasons"))


def _processed(spark, sf, mode):
    responses = derive(spark, sf, derived.RESPONSES)
    return policy.processed_content(
        _texts(spark, sf).select("doc_id", "text"), "doc_id", "text", responses, mode
    ).select("doc_id", "processed")


@query
def processed_content(spark, sf):
    return _processed(spark, sf, "filtered")


@query
def processed_responses(spark, sf):
    return _processed(spark, sf, "response")


def _typed(spark, sf):
    """Documents with a URL, some as text and some as markup, classified."""
    content = F.when(F.col("doc_id") % 3 == 0, F.col("html")).otherwise(F.col("text"))
    pages = _addressed(spark, sf).select("doc_id", "url", content.alias("content"))
    return classify.classify_pages(pages, "url", "content")


@query
def content_signals(spark, sf):
    return _text(_typed(spark, sf).select("doc_id", "signals"), "signals")


@query
def page_signals(spark, sf):
    signals = classify.content_signals(F.col("html")).alias("signals")
    return _text(table(spark, sf, "pages").select("page_id", signals), "signals")


@query
def page_context(spark, sf):
    return _typed(spark, sf).select(
        "doc_id", "page_type", "content_length", "structure_type", "target_audience"
    )


@query
def page_type_counts(spark, sf):
    return classify.page_type_counts(_typed(spark, sf))


@query
def build_prompts(spark, sf):
    templates = derive(spark, sf, derived.TEMPLATES)
    prompts = classify.build_prompts(_typed(spark, sf), "content", templates, "doc_id")
    return prompts.select("doc_id", "prompt")


# Graph, de-duplication, aggregation


def _edges(spark, sf):
    return derive(spark, sf, derived.EDGES)


def _seeds(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.filter(F.col("url").contains("page=2")).select(F.col("page_id").alias("node"))


@query
def crawl_bfs(spark, sf):
    return _long(crawl.crawl_bfs(_edges(spark, sf), _seeds(spark, sf)), "depth")


def _nodes(spark, sf):
    status = (
        F.when(F.col("page_id") % 17 == 5, "failed")
        .when(F.col("page_id") % 11 == 4, "no_content")
        .otherwise("ok")
    )
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("node"), route_of(F.col("url")).alias("route"), status.alias("status")
    )


@query
def crawl_routes(spark, sf):
    routes = _nodes(spark, sf).withColumn("route", F.right(F.col("route"), F.lit(2)))
    return _long(crawl.crawl_routes(_edges(spark, sf), _seeds(spark, sf), routes), "depth")


@query
def frontier_unseen(spark, sf):
    found = links.extract_links(table(spark, sf, "pages")).select("link")
    mixed = links.extract_links(_mixed(spark, sf)).select("link")
    return crawl.frontier_unseen(mixed.union(found), mixed.filter(F.col("link").contains("docs/1")))


@query
def route_dedup(spark, sf):
    return crawl.route_dedup(_urls(spark, sf), _by_url()).select("doc_id", "route", "url")


@query
def inflight_dedup(spark, sf):
    calls = requests(spark, sf).withColumn("url", F.concat_ws("/", "event_type", "user_id"))
    return crawl.inflight_dedup(calls, "url", "event_id")


@query
def cache_hits(spark, sf):
    return rates.cache_hits(requests(spark, sf), "user_id", "ts", "event_id").select(
        "event_id", "user_id", "hit"
    )


@query
def reuse_asof(spark, sf):
    """Which stored page serves each view or click: users stand for routes, their signups for fetches."""
    log = requests(spark, sf)
    asked = log.filter("event_type IN ('view', 'click')").select("event_id", "user_id", "ts")
    fetched = log.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("snapshot_id"))
    found = rates.reuse_asof(asked, fetched, "user_id", "ts", "snapshot_id", ttl_ms=48 * rates.TTL_MS)
    return found.select("event_id", "user_id", "snapshot_id", "age_ms")


@query
def cache_capacity(spark, sf):
    kept = crawl.cache_capacity(requests(spark, sf), "user_id", "ts", "event_id", size=100)
    return kept.select("user_id", F.unix_millis("last_access").alias("last_ms"), "last_id")


@query
def crawl_batches(spark, sf):
    return _long(_text(links.crawl_batches(table(spark, sf, "pages")), "links"), "batch")


@query
def error_rows(spark, sf):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    rows = _results(spark, sf).join(_texts(spark, sf).select("doc_id", "text"), "doc_id")
    rows = rows.withColumns(
        {"content": F.col("text"), "processed": text.mask_phrases(F.col("text")), "fetched_at": at}
    )
    merged = crawl.error_rows(
        rows.filter(F.col("error").isNull()), rows.filter(F.col("error").isNotNull())
    )
    return merged.select(
        "url", "content", "processed", F.unix_millis("fetched_at").alias("fetched_ms"), "error"
    )


@query
def report_totals(spark, sf):
    return report.report_totals(_results(spark, sf))


@query
def report_merged(spark, sf):
    """The report after three runs, one of them repeated; sketches only say whether they are close."""
    results, store = _results(spark, sf), ingest.scratch(spark, "summaries")
    for run in (0, 1, 2, 1):
        summaries.add_run(results.filter(F.col("doc_id") % 3 == run), f"r{run}", store)
    found = summaries.report(summaries.summaries(spark, store)).first()
    size, median = F.col("content_size"), found["size_quantiles"][0]
    exact = {c: F.lit(found[c]).alias(c) for c in ("total", "successful", "failed", "total_size")}
    distinct = F.countDistinct(route_of(F.col("url")))
    return results.agg(
        *exact.values(),
        F.round(F.lit(found["success_rate"]), 6).alias("success_rate"),
        F.round(F.lit(found["avg_processing_ms"]), 6).alias("avg_processing_ms"),
        (F.abs(found["routes"] - distinct) <= 0.04 * distinct).alias("routes_close"),
        ((F.avg((size < median).cast("int")) <= 0.53) & (F.avg((size <= median).cast("int")) >= 0.47)).alias("median_close"),
    ).selectExpr("CAST(total AS BIGINT) AS total", "CAST(successful AS BIGINT) AS successful", "CAST(failed AS BIGINT) AS failed",
                 "CAST(total_size AS BIGINT) AS total_size", "success_rate", "avg_processing_ms", "routes_close", "median_close")


@query
def failed_urls(spark, sf):
    return report.failed_urls(_results(spark, sf))


@query
def route_urls(spark, sf):
    return report.route_urls(_results(spark, sf))


@query
def route_url_lists(spark, sf):
    return _text(report.route_url_lists(_results(spark, sf), "doc_id", size=10), "urls", " ")


@query
def crawl_stats(spark, sf):
    stats = report.crawl_stats(_results(spark, sf))
    return stats.select(
        F.round("success_rate", 6).alias("success_rate"),
        "total_size",
        F.round("avg_processing_ms", 6).alias("avg_processing_ms"),
    )


@query
def results_table(spark, sf):
    return report.results_table(_results(spark, sf))


@query
def latest_version(spark, sf):
    return catalog.latest_version(
        derive(spark, sf, derived.CATALOGUE), "family", "name", "p_partkey"
    )


def _site_crawl(spark, sf):
    site = derive(spark, sf, derived.SITE)
    starts = _seeds(spark, sf).withColumnRenamed("node", "page_id")
    seeds = site.join(starts, "page_id", "left_semi").select("url")
    return pipeline.crawl_corpus(site, seeds)


@query
def crawl_site(spark, sf):
    return _site_crawl(spark, sf).results.drop("processing_ms")


@query
def crawl_site_content(spark, sf):
    return _site_crawl(spark, sf).content


# URL keys and sizes


@query
def url_parts(spark, sf):
    return links.url_parts(_urls(spark, sf).select("doc_id", "url"))


@query
def page_routes(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id", is_valid_url(F.col("url")).alias("valid"), route_of(F.col("url")).alias("route")
    )


@query
def pretty_sizes(spark, sf):
    # Up to 1e17 at any scale.
    digits = F.col("l_orderkey") * 7919 % 1_000_003
    power = F.pow(F.lit(10), F.col("l_orderkey") % 12).cast("bigint")
    sizes = table(spark, sf, "lineitem").select((digits * power + F.col("l_partkey") % 1000).alias("n"))
    return sizes.groupBy("n").count().select("n", pretty_bytes(F.col("n")).alias("size"))


# Streams and request logs


@query
def throttle_events(spark, sf):
    return rates.throttle_events(
        requests(spark, sf), "event_type", "ts", "event_id", capacity=5, rate=1 / 1800
    ).select("event_id", "event_type", "admitted")


@query
def throttle_users(spark, sf):
    admitted = rates.throttle_events(
        requests(spark, sf), "user_id", "ts", "event_id", capacity=2, rate=1 / 14400
    )
    return admitted.groupBy("user_id").agg(
        F.count_if("admitted").alias("n_admitted"), F.count_if(~F.col("admitted")).alias("n_delayed")
    )


@query
def rate_audit(spark, sf):
    return rates.rate_audit(requests(spark, sf), "event_type", "ts", 3, "1 hour")


@query
def rate_audit_sliding(spark, sf):
    return rates.rate_audit(requests(spark, sf), "event_type", "ts", 4, "1 hour", "15 minutes")


@query
def cache_sessions(spark, sf):
    return rates.cache_sessions(requests(spark, sf), "user_id", "ts", "event_id")


@query
def retry_schedule(spark, sf):
    failures = requests(spark, sf).filter("event_type = 'error'").select(
        "event_id",
        F.when(F.col("event_id") % 2 == 0, "HTTP 429 too many").otherwise("timeout").alias("error"),
        (F.col("user_id") % 5 + 1).alias("attempt"),
        F.unix_millis("ts").alias("failed_ms"),
    )
    return rates.retry_schedule(failures, "error", "attempt", "failed_ms")


def _replay(spark, sf, name, job):
    """A streaming job over the whole event log, all windows closed."""
    schema = table(spark, sf, "events").schema
    return ingest.replay(
        spark, ingest.given(sf, "events.parquet"), schema, "*", "ts", lambda s: job(readers.utc_times(s, "ts")), name
    )


@query
def throttle_stream(spark, sf):
    return _replay(
        spark,
        sf,
        "throttle",
        lambda s: live.throttle_stream(s, "event_type", "ts", capacity=5, rate=1 / 1800),
    )


@query
def rate_audit_stream(spark, sf):
    return _replay(
        spark, sf, "audit", lambda s: live.rate_audit_stream(s, "event_type", "ts", 3, "1 hour")
    )


@query
def session_stream(spark, sf):
    return _replay(spark, sf, "sessions", lambda s: live.session_stream(s, "user_id", "ts"))


@query
def stream_dedup(spark, sf):
    return _replay(spark, sf, "dedup", lambda s: live.dedup_stream(s, "user_id", "ts"))


@query
def stream_ingest(spark, sf):
    pages = ingest.stream_table(spark, ingest.given(sf, "pages.parquet"), readers.PAGES, "*")
    store, state = ingest.scratch(spark, "pages"), ingest.scratch(spark, "pages-state")
    ingest.ingest_pages(pages, store, state).awaitTermination()
    return spark.read.parquet(store).select("page_id", "route", "url")


# Structured extraction, chunking, similarity


@query
def structured_extract(spark, sf):
    fields = [
        {"name": "name", "selector": "a"},
        {"name": "link", "selector": "a", "attribute": "href"},
        {"name": "image", "selector": "img.thumb", "attribute": "src"},
    ]
    return _long(extract.page_records(table(spark, sf, "pages"), "nav li", fields), "pos")


@query
def structured_titles(spark, sf):
    fields = [{"name": "title", "selector": "h1"}]
    return _long(extract.page_records(table(spark, sf, "pages"), "article", fields), "pos")


@query
def topic_chunks(spark, sf):
    docs = table(spark, sf, "documents").withColumn(
        "text", F.regexp_replace("text", r"\n([A-Z])", "\n \nPart One\n$1")
    )
    return _long(chunks.topic_chunks(docs, "doc_id", "text"), "chunk")


@query
def semantic_chunks(spark, sf):
    rows = chunks.semantic_chunks(table(spark, sf, "documents"), "doc_id", "text")
    return _long(rows, "chunk", "n_sentences")


@query
def topic_segments(spark, sf):
    rows = topics.topic_segments(table(spark, sf, "documents"), "doc_id", "text")
    return _long(rows, "segment", "n_sentences")


@query
def cosine_dedup(spark, sf):
    return similar.cosine_dedup(derived.vectors(spark, sf), "vec_id", "embedding")


# Flagship: what kinds of pages does the corpus hold, and how many are restricted


@query
def corpus_overview(spark, sf):
    return overview(spark, sf)


def overview(spark: SparkSession, sf: str) -> DataFrame:
    typed = _typed(spark, sf).select("doc_id", "url", "page_type")
    flagged = policy.flag_restricted(typed, "url", _blocklist(spark, sf), "doc_id")
    return flagged.groupBy("page_type", "restricted").agg(
        F.count("*").alias("n_pages"),
        F.count_distinct(route_of(F.col("url"))).alias("n_routes"),
    )
