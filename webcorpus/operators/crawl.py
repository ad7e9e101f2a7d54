"""Link-graph traversal, storage routes and request de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.functions.urls import route_of
from webcorpus.operators.joins import lookup_join, measured_bytes
from webcorpus.operators.layout import LinkGraph, Visited
from webcorpus.session import cut_lineage

MAX_DEPTH = 3
CACHE_SIZE = 1000


def firsts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each group.

    Spark turns ``row_number() = 1`` into a group limit that runs before the shuffle, so a
    group that holds a large share of the rows sends one row per input partition.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def crawl_bfs(
    edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH, expand: DataFrame | None = None
) -> DataFrame:
    """(node, depth): nodes within ``max_depth`` links of the seeds, at their smallest depth.

    ``edges`` is (src, dst), ``seeds`` (node). ``expand``, when given, lists the only nodes whose
    links are followed. Links are not moved from level to level (see ``LinkGraph``). Each level is
    written to the shared checkpoint folder, which bounds the plan and survives lost executors.
    """
    graph = LinkGraph(edges)
    frontier = cut_lineage(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    visited, seen = frontier, Visited()
    for depth in range(1, max_depth + 1):
        size = measured_bytes(frontier.select("node"))
        if not size:
            break
        seen.add(frontier, size)
        sources = frontier if expand is None else frontier.join(expand, "node", "left_semi")
        fresh = seen.unseen(graph.targets(sources, size))
        frontier = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
    return visited


def crawl_routes(
    edges: DataFrame,
    seeds: DataFrame,
    nodes: DataFrame,
    max_depth: int = MAX_DEPTH,
    stored: DataFrame | None = None,
    expand_reused: bool = False,
) -> DataFrame:
    """(node, depth, outcome): traversal in which pages of one storage route are fetched once.

    ``nodes`` is (node, route, status) with status ok, no_content or failed; ``stored`` lists
    routes saved by earlier runs. The first ok node of a route (smallest depth, then smallest
    node) is ``stored``; other nodes of that route are ``reused`` and, unless
    ``expand_reused``, their links are not followed. A page without content is still expanded,
    a page that could not be opened is not. Links to nodes that are not listed are ``missing``.
    """
    graph = LinkGraph(edges)
    schema = nodes.select("route")
    taken = schema.limit(0) if stored is None else stored.select("route").distinct()
    level = cut_lineage(seeds.select("node").distinct())
    seen, results = Visited(), None
    for depth in range(max_depth + 1):
        pages = level.join(nodes, "node", "left").withColumn(
            "status", F.coalesce("status", F.lit("missing"))
        )
        known = lookup_join(
            pages, taken.withColumn("_known", F.lit(True)), "route", spread_by="node"
        )
        owners = (
            known.filter(F.col("_known").isNull() & (F.col("status") == "ok"))
            .groupBy("route")
            .agg(F.min("node").alias("_owner"))
        )
        decided = lookup_join(known, owners, "route", spread_by="node", settle=True)
        outcome = (
            F.when(F.col("_known"), "reused")
            .when(F.col("status") != "ok", F.col("status"))
            .when(F.col("node") == F.col("_owner"), "stored")
            .otherwise("reused")
        )
        done = cut_lineage(
            decided.select(
                "node", "route", F.lit(depth).alias("depth"), outcome.alias("outcome")
            )
        )
        results = done if results is None else results.unionByName(done)
        if depth == max_depth:
            break
        taken = taken.unionByName(done.filter("outcome = 'stored'").select("route"))
        followed = ["stored", "no_content"] + (["reused"] if expand_reused else [])
        sources = done.filter(F.col("outcome").isin(followed))
        size = measured_bytes(level)
        seen.add(level, size)
        level = cut_lineage(seen.unseen(graph.targets(sources, size)))
        if level.isEmpty():
            break
    return results.select("node", "depth", "outcome")


def frontier_unseen(links: DataFrame, seen: DataFrame, link: str = "link") -> DataFrame:
    """Distinct links that were not processed yet; ``seen`` has the same column."""
    return links.select(link).distinct().join(seen.select(link), link, "left_anti")


def reuse_existing(frontier: DataFrame, stored: DataFrame, row_id: str, url: str = "url"):
    """Add the route and whether output for it is already stored; ``stored`` is (route)."""
    known = stored.select("route").distinct().withColumn("_known", F.lit(True))
    routed = frontier.withColumn("route", route_of(F.col(url)))
    return (
        lookup_join(routed, known, "route", spread_by=row_id)
        .withColumn("reused", F.coalesce("_known", F.lit(False)))
        .drop("_known")
    )


def route_dedup(pages: DataFrame, order: list[Column], url: str = "url") -> DataFrame:
    """One page per storage route, the first in ``order``."""
    return firsts(pages.withColumn("route", route_of(F.col(url))), ["route"], order)


def inflight_dedup(requests: DataFrame, url: str, row_id: str) -> DataFrame:
    """One row per URL with the request that computes it and how many share the result."""
    return requests.groupBy(url).agg(
        F.min(row_id).alias("first_request"), F.count("*").alias("n_requests")
    )


def error_rows(done: DataFrame, failed: DataFrame) -> DataFrame:
    """Results and failures in one table; failures get empty texts."""
    blank = failed.select("url", "error", "fetched_at").withColumns(
        {"content": F.lit(""), "processed": F.lit("")}
    )
    full = done.select("url", "content", "processed", "fetched_at").withColumn(
        "error", F.lit(None).cast("string")
    )
    return full.unionByName(blank)


def cache_capacity(requests: DataFrame, key: str, ts: str, row_id: str, size: int = CACHE_SIZE):
    """Keys a cache of ``size`` entries still holds: the most recently used ones."""
    last = requests.groupBy(key).agg(F.max(F.struct(ts, row_id)).alias("_last"))
    return (
        last.select(key, F.col("_last")[ts].alias("last_access"), F.col("_last")[row_id].alias("last_id"))
        .orderBy(F.desc("last_access"), F.desc("last_id"))
        .limit(size)
    )
