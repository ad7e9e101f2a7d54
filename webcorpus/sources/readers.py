"""Corpus and log tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
FORMATS = ("parquet", "orc", "json", "csv")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Read a table; without inference for the text formats."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format: {fmt}")
    if schema is None and fmt in ("json", "csv"):
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The fetched corpus: (page_id, url, html)."""
    return read_table(spark, path, PAGES, fmt)


def utc_times(df: DataFrame, ts: str) -> DataFrame:
    """Read the zone-less times of a column as UTC, whatever the session's zone is."""
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        return df
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    return df.withColumn(ts, F.timestamp_micros(micros))


def read_requests(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A request log with its times as UTC instants."""
    return utc_times(spark.read.parquet(path), ts)


def scan_pages(pages: DataFrame) -> DataFrame:
    """Inventory of the corpus."""
    return pages.select(
        "page_id", "url", F.length("html").cast("bigint").alias("n_chars")
    )
