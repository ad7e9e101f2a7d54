"""Crawl reports kept up to date: a small summary per run, merged instead of recounted.

Counts and sums are exact. Distinct routes and quantiles of sizes are kept as sketches, which merge
like sums; their errors do not grow with the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.functions.urls import route_of
from webcorpus.operators.report import _failed
from webcorpus.session import path_exists

LOG_SLOTS = 14  # slots of a distinct count, as a power of two: standard error 1.04 / sqrt(2 ** 14), 0.8 %
QUANTILE_SIZE = 400  # of a quantile sketch: ranks within about 0.7 %
SCHEMA = (
    "run string, total bigint, failed bigint, total_size bigint, processing_ms bigint, routes binary, sizes binary"
)


def run_summary(results: DataFrame) -> DataFrame:
    """One row for the results (url, error, content_size, processing_ms) of a run."""
    size = F.coalesce("content_size", F.lit(0)).cast("bigint")
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(_failed()).alias("failed"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum(F.coalesce("processing_ms", F.lit(0)).cast("bigint")), F.lit(0)).alias("processing_ms"),
        F.hll_sketch_agg(route_of(F.col("url")), F.lit(LOG_SLOTS)).alias("routes"),
        F.kll_sketch_agg_bigint(size, F.lit(QUANTILE_SIZE)).alias("sizes"),
    )


def add_run(results: DataFrame, run: str, store: str) -> None:
    """Write the summary of a run; a repeated run replaces its own."""
    run_summary(results).write.mode("overwrite").parquet(f"{store}/run={run}")


def summaries(spark: SparkSession, store: str) -> DataFrame:
    """The summaries of all runs; none if nothing was stored yet."""
    if not path_exists(spark, store):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(store)


def _merged_sizes() -> Column:
    # Runs without rows have sketches like any other; an empty list stays NULL.
    each = F.collect_list("sizes")
    return F.aggregate(F.slice(each, F.lit(2), F.greatest(F.size(each) - 1, F.lit(0))), F.get(each, F.lit(0)), F.kll_sketch_merge_bigint)


def merged(runs: DataFrame) -> DataFrame:
    """One summary of many; merging summaries of parts of the runs gives the same counts."""
    return runs.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("total_size"), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("processing_ms"), F.lit(0)).alias("processing_ms"),
        F.hll_union_agg("routes", F.lit(False)).alias("routes"),
        _merged_sizes().alias("sizes"),
    )


def report(runs: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Totals, rates and means as a recount gives them, about how many routes, and sizes by quantile.

    Without any row the rates, means and quantiles are NULL.
    """
    n = F.col("total")
    found = F.when(n > 0, F.kll_sketch_get_quantile_bigint("sizes", F.array(*map(F.lit, quantiles))))
    return merged(runs).select(
        "total",
        (n - F.col("failed")).alias("successful"),
        "failed",
        F.when(n > 0, (n - F.col("failed")) / n * 100).alias("success_rate"),
        "total_size",
        F.when(n > 0, F.col("processing_ms") / n).alias("avg_processing_ms"),
        F.coalesce(F.hll_sketch_estimate("routes"), F.lit(0)).alias("routes"),
        found.alias("size_quantiles"),
    )
