"""Crawl a stored corpus: spark-submit --py-files webcorpus.zip -m webcorpus, or python -m webcorpus."""

from __future__ import annotations

import argparse
import sys

FORMATS = ("json", "csv", "markdown")


class Options(argparse.ArgumentParser):
    def format_help(self) -> str:
        return super().format_help().replace("usage:", "Usage:", 1)

    def error(self, message: str):
        needed = "the following arguments are required:"
        self.exit(2, f"error: {message.replace(needed, 'required option not specified:')}\n")


def options() -> Options:
    parser = Options(prog="webcorpus", description="Crawl a corpus of stored pages.")
    parser.add_argument("-p", "--pages", required=True, help="table of (page_id, url, html)")
    parser.add_argument("-u", "--url", required=True, help="URL to start from")
    parser.add_argument("-o", "--output", default="crawl_output", help="output folder")
    parser.add_argument("-d", "--depth", type=int, default=3, help="maximum link depth")
    parser.add_argument("-f", "--format", choices=FORMATS, default="json", help="result format")
    parser.add_argument("--input-format", default="parquet", help="parquet, orc, json or csv")
    parser.add_argument("--blocklist", help="parquet table of restricted sites (domain)")
    return parser


def main(arguments: list[str] | None = None) -> int:
    chosen = options().parse_args(arguments)

    from pyspark.sql import functions as F

    from webcorpus.functions.urls import is_valid_url
    from webcorpus.operators.policy import load_blocklist
    from webcorpus.operators.report import crawl_stats
    from webcorpus.plans.pipeline import crawl_corpus
    from webcorpus.session import build_session
    from webcorpus.sources.readers import read_pages
    from webcorpus.sources.sinks import stored_routes

    spark = build_session()
    seeds = spark.createDataFrame([(chosen.url,)], "url string")
    if seeds.filter(is_valid_url(F.col("url"))).isEmpty():
        print("Error: Invalid URL", file=sys.stderr)
        return 1
    listed = chosen.blocklist and load_blocklist(spark.read.parquet(chosen.blocklist), "domain")
    pages = read_pages(spark, chosen.pages, chosen.input_format)
    stored = stored_routes(spark, f"{chosen.output}/store")
    found = crawl_corpus(pages, seeds, chosen.depth, listed, stored=stored)
    found.save(chosen.output, chosen.format)
    stats = crawl_stats(found.results).first()
    print(f"Success rate: {stats.success_rate or 0:.2f}%  Characters: {stats.total_size or 0}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
