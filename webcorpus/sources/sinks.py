"""Stored content and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions.urls import route_of
from webcorpus.operators.crawl import firsts
from webcorpus.operators.joins import lookup_join
from webcorpus.operators.report import csv_lines, header_lines, json_lines, markdown_lines
from webcorpus.session import cut_lineage, path_exists

EXPORTS = ("json", "csv", "markdown")


def new_content(
    pages: DataFrame, order: list[Column], row_id: str, stored: DataFrame | None = None
) -> DataFrame:
    """(route, kind, url, body): what a run adds to the store.

    ``pages`` is (url, content, processed); the first non-empty text of a route and kind wins,
    and what ``stored`` (route, kind) already has is left alone.
    """
    kinds = F.array(
        F.struct(F.lit("content").alias("kind"), F.col("content").alias("body")),
        F.struct(F.lit("processed").alias("kind"), F.col("processed").alias("body")),
    )
    rows = pages.select("*", route_of(F.col("url")).alias("route"), F.inline(kinds))
    rows = rows.filter(F.col("body") != "")
    if stored is not None:
        known = stored.select("route", "kind").distinct()
        rows = lookup_join(rows, known, ["route", "kind"], "left_anti", spread_by=row_id)
    return firsts(rows, ["route", "kind"], order).select("route", "kind", "url", "body")


def save_content(content: DataFrame, path: str) -> None:
    """Append to the store, one folder per kind."""
    content.write.mode("append").partitionBy("kind").parquet(path)


def stored_routes(spark: SparkSession, path: str) -> DataFrame | None:
    """(route, kind) of what earlier runs stored, written down; None without a store."""
    if not path_exists(spark, path):
        return None
    return cut_lineage(spark.read.parquet(path).select("route", "kind").distinct())


def export_results(results: DataFrame, fmt: str, path: str) -> None:
    """Write results as json, csv or markdown lines; the header stands in its own first file.

    Each task writes its own part, so nothing is gathered in one place.
    """
    writers = {"json": json_lines, "csv": csv_lines, "markdown": markdown_lines}
    fmt = fmt.lower()
    if fmt not in EXPORTS:
        raise ValueError(f"Unsupported export format: {fmt}")
    lines = writers[fmt](results)
    header = header_lines(fmt)
    if header:
        spark = results.sparkSession
        top = spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1)
        lines = top.unionByName(lines)
    lines.write.mode("overwrite").text(path)


def export_quoted_csv(results: DataFrame, path: str) -> None:
    """Machine-readable CSV: a header in every part, quoted where needed."""
    results.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def save_report(report: DataFrame, path: str) -> None:
    """Write report lines, one folder per section."""
    report.write.mode("overwrite").partitionBy("section").text(path)
