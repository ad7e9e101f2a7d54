"""The whole crawl of a stored corpus: links, traversal, content, results, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.text import mask_phrases
from webcorpus.functions.urls import absolute_url, canonical_link, route_of, site_key
from webcorpus.operators import crawl, extract, links, policy, report
from webcorpus.operators.joins import lookup_join
from webcorpus.session import cut_lineage
from webcorpus.sources import sinks
from webcorpus.streaming.ingest import scratch

MISSING = "Page is not in the corpus"


@dataclass
class Crawl:
    """Results (one row per visited URL) and the texts that belong in the store."""

    results: DataFrame
    content: DataFrame

    def save(self, output: str, fmt: str) -> None:
        """Write the store, the results in the wanted format and the report."""
        sinks.save_content(self.content, f"{output}/store")
        sinks.export_results(self.results, fmt, f"{output}/results")
        sinks.save_report(report.crawl_report(self.results, "url"), f"{output}/report")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder; its readers load only the columns they need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def parse_pages(
    pages: DataFrame,
    blocklist: DataFrame | None = None,
    first_block: bool = False,
    first_only: bool = False,
) -> DataFrame:
    """(node, page_id, route, links, content, error) of every page with a valid URL.

    The content is all distinct blocks, masked everywhere; ``first_block`` keeps the first block
    only, ``first_only`` masks the first hit of each phrase only. The markup is read once; what it
    yields is written down, and only then are the sites looked up.
    """
    if first_block:
        content = mask_phrases(extract.first_text(F.col("html")), first_only)
    else:
        content = extract.all_text(F.col("html"), first_only)
    named = policy.name_flags(pages, policy.domain_key(F.col("url")))
    parsed = named.select(
        canonical_link(absolute_url(F.col("url"))).alias("node"),
        "page_id",
        route_of(F.col("url")).alias("route"),
        links.page_links(F.col("html"), F.col("url")).alias("links"),
        content.alias("text"),
        "_key",
        "_form",
    ).filter("node IS NOT NULL")
    parsed = _written(parsed, "parsed")
    if blocklist is None:
        flagged = parsed.withColumnRenamed("_form", "restricted").drop("_key")
    else:
        flagged = policy.flag_names(parsed, blocklist, "page_id", "restricted")
    error = F.when(F.col("restricted"), policy.RESTRICTED_ERROR).when(
        F.col("text").isNull(), extract.no_content(F.col("node"))
    )
    found = F.when(~F.col("restricted"), F.col("text"))
    return flagged.withColumns({"content": found, "error": error}).drop("text", "restricted")


def page_nodes(parsed: DataFrame) -> DataFrame:
    """One row per canonical URL, that of its first page; copies are reduced before the shuffle."""
    fields = F.struct(
        "page_id",
        "route",
        "error",
        F.length("content").alias("n_chars"),
        F.size("links").alias("n_links"),
    )
    first = parsed.groupBy("node").agg(F.min_by(fields, "page_id").alias("_first"))
    return _written(first.select("node", "_first.*"), "nodes")


def page_edges(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst) links of the pages that stand for a node."""
    rows = parsed.select("node", "page_id", "links").join(nodes, ["node", "page_id"], "left_semi")
    return _written(rows.select(F.col("node").alias("src"), F.explode("links").alias("dst")), "edges")


def crawl_corpus(
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int = crawl.MAX_DEPTH,
    blocklist: DataFrame | None = None,
    responses: DataFrame | None = None,
    stored: DataFrame | None = None,
    expand_reused: bool = False,
    first_block: bool = False,
    first_only: bool = False,
) -> Crawl:
    """Crawl a corpus of (page_id, url, html) from the URLs in ``seeds`` (url).

    Links are followed within a site only, so pages of other sites than the seeds' go before any
    markup is read. ``first_block`` and ``first_only`` are those of :func:`parse_pages`.
    ``responses`` is a model's answer log (page_id, response, response_error, response_valid);
    without it the processed text is the masked content. ``stored`` lists (route, kind) of
    earlier runs.
    """
    sites = seeds.select(site_key(F.col("url")).alias("_site")).filter("_site IS NOT NULL")
    near = lookup_join(
        pages.withColumn("_site", site_key(F.col("url"))), sites.distinct(), "_site", "left_semi", "page_id"
    )
    parsed = parse_pages(near.drop("_site"), blocklist, first_block, first_only)
    nodes = page_nodes(parsed)
    edges = page_edges(parsed, nodes)
    status = F.when(F.col("error").isNull(), "ok").otherwise("no_content")
    starts = seeds.select(canonical_link(absolute_url(F.col("url"))).alias("node"))
    known = None if stored is None else stored.filter("kind = 'content'")
    visited = cut_lineage(
        crawl.crawl_routes(
            edges,
            starts.filter("node IS NOT NULL"),
            nodes.select("node", "route", status.alias("status")),
            max_depth,
            known,
            expand_reused,
        )
    )

    rows = visited.join(nodes, "node", "left")
    kept = F.col("outcome") == "stored"
    opened = F.col("outcome").isin("stored", "no_content")
    results = rows.select(
        F.col("node").alias("url"),
        "route",
        F.col("depth").cast("bigint").alias("depth"),
        "outcome",
        F.when(F.col("outcome") == "missing", MISSING).when(opened, F.col("error")).alias("error"),
        F.when(kept, F.col("n_chars")).cast("bigint").alias("content_size"),
        F.when(opened, F.col("n_links")).cast("bigint").alias("found_links"),
        F.lit(None).cast("bigint").alias("processing_ms"),
    )

    chosen = rows.filter(kept).select("node", "page_id")
    texts = parsed.join(chosen, ["node", "page_id"], "left_semi").select(
        F.col("node").alias("url"), "page_id", "content"
    )
    if responses is None:
        texts = texts.withColumn("processed", F.col("content"))
    else:
        texts = policy.processed_content(
            texts, "page_id", "content", responses, first_only=first_only
        )
    content = sinks.new_content(texts, [F.col("page_id")], "page_id", stored)
    return Crawl(results, content)
