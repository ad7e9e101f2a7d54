"""Summaries and export lines for crawl results (url, error, content_size, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.sizes import pretty_bytes
from webcorpus.functions.urls import route_of
from webcorpus.operators.joins import lookup_join

LIST_SIZE = 1000

# Export columns and marks.
EXPORT_COLUMNS = ["URL", "Status", "Content Size", "Processing Time", "Links Found", "Error"]
OK, FAILED = "Success", "Failed"
OK_MARK, FAILED_MARK = "✅ Success", "❌ Failed"


def _failed() -> Column:
    return F.coalesce(F.col("error") != "", F.lit(False))


def _or_blank(value: Column, blank: str) -> Column:
    """Text of a value; zero, '' and NULL become ``blank``."""
    text = value.cast("string")
    return F.when(text.isNull() | text.isin("", "0"), blank).otherwise(text)


def report_totals(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(~_failed()).alias("successful"),
        F.count_if(_failed()).alias("failed"),
    )


def failed_urls(results: DataFrame) -> DataFrame:
    return results.filter(_failed()).select("url", "error")


def route_urls(results: DataFrame) -> DataFrame:
    """(route, url): which URLs share a storage route."""
    return results.select(route_of(F.col("url")).alias("route"), "url")


def route_url_lists(results: DataFrame, row_id: str, size: int = LIST_SIZE) -> DataFrame:
    """(route, part, urls): sorted URL lists of about ``size`` entries.

    A route may hold most of a crawl, so its URLs are split by hash into as many lists as its
    count asks for, instead of being collected in one place.
    """
    routed = results.select(row_id, route_of(F.col("url")).alias("route"), "url")
    parts = routed.groupBy("route").agg(
        F.ceil(F.count("*") / F.lit(size)).cast("bigint").alias("_parts")
    )
    spread = lookup_join(routed, parts, "route", spread_by=row_id, settle=True)
    # With the row id, or all copies of one URL would be in one list.
    mark = F.md5(F.concat_ws("#", "url", F.col(row_id).cast("string")))
    slot = F.conv(F.substring(mark, 1, 8), 16, 10).cast("bigint") % F.col("_parts")
    return spread.groupBy("route", slot.alias("part")).agg(
        F.array_sort(F.collect_list("url")).alias("urls")
    )


def crawl_stats(results: DataFrame) -> DataFrame:
    """Success rate, total size and mean processing time over all rows; NULL when empty."""
    return results.agg(
        (F.avg(F.when(_failed(), 0.0).otherwise(1.0)) * 100).alias("success_rate"),
        F.sum(F.coalesce("content_size", F.lit(0))).alias("total_size"),
        F.avg(F.coalesce("processing_ms", F.lit(0))).alias("avg_processing_ms"),
    )


def results_table(results: DataFrame) -> DataFrame:
    """Display columns; a failed page shows dashes."""

    def shown(value: Column) -> Column:
        return F.when(_failed(), "-").otherwise(value)

    size = pretty_bytes(F.coalesce("content_size", F.lit(0)))
    time = F.concat(F.coalesce("processing_ms", F.lit(0)).cast("string"), F.lit("ms"))
    links = F.coalesce("found_links", F.lit(0)).cast("string")
    return results.select(
        "url",
        F.when(_failed(), FAILED).otherwise(OK).alias("status"),
        shown(size).alias("size"),
        shown(time).alias("processing_time"),
        shown(links).alias("links_found"),
    )


def json_lines(results: DataFrame) -> DataFrame:
    """One ``[url, {...}]`` pair per line; absent fields are left out."""
    fields = F.to_json(F.struct("url", "error", "content_size", "found_links", "processing_ms"))
    url = F.regexp_extract(F.to_json(F.struct("url")), r'^\{"url":(.*)\}$', 1)
    return results.select(F.concat(F.lit("["), url, F.lit(","), fields, F.lit("]")).alias("value"))


def csv_lines(results: DataFrame) -> DataFrame:
    """Unquoted comma-separated lines without the header (see ``header_line``)."""
    return results.select(
        F.concat_ws(
            ",",
            "url",
            F.when(_failed(), FAILED).otherwise(OK),
            _or_blank(F.col("content_size"), ""),
            _or_blank(F.col("processing_ms"), ""),
            _or_blank(F.col("found_links"), ""),
            _or_blank(F.col("error"), ""),
        ).alias("value")
    )


def markdown_lines(results: DataFrame) -> DataFrame:
    """Rows of a pipe table without its two header lines."""
    size = F.when(F.col("content_size") > 0, pretty_bytes(F.col("content_size"))).otherwise("-")
    time = F.when(
        F.col("processing_ms") > 0, F.concat(F.col("processing_ms").cast("string"), F.lit("ms"))
    ).otherwise("-")
    return results.select(
        F.concat_ws(
            "|",
            "url",
            F.when(_failed(), FAILED_MARK).otherwise(OK_MARK),
            size,
            time,
            _or_blank(F.col("found_links"), "-"),
            _or_blank(F.col("error"), "-"),
        ).alias("value")
    )


def header_lines(export: str) -> list[str]:
    """Lines that stand above the rows of an export."""
    if export == "csv":
        return [",".join(EXPORT_COLUMNS)]
    if export == "markdown":
        return ["|".join(EXPORT_COLUMNS), "|".join("---" for _ in EXPORT_COLUMNS)]
    return []


def crawl_report(results: DataFrame, row_id: str, size: int = LIST_SIZE) -> DataFrame:
    """The run's report as JSON lines: totals, one line per failure, one per list of URLs."""
    totals = report_totals(results).select(
        F.lit("totals").alias("section"), F.to_json(F.struct("total", "successful", "failed")).alias("value")
    )
    failures = failed_urls(results).select(
        F.lit("failed").alias("section"), F.to_json(F.struct("url", "error")).alias("value")
    )
    routes = route_url_lists(results, row_id, size).select(
        F.lit("route").alias("section"), F.to_json(F.struct("route", "part", "urls")).alias("value")
    )
    return totals.unionByName(failures).unionByName(routes)
