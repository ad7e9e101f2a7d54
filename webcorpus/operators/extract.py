"""Text blocks, code blocks, structured records and Markdown from pages.

Everything a page yields is produced inside its own row; only counts are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.common import trim_space
from webcorpus.functions.text import clean_text, heading_line, mask_phrases
from webcorpus.operators.markup import page_blocks, records_column

# Languages looked for in a class name, in this order; the first one wins.
LANGUAGES = ["javascript", "typescript", "python", "java", "cpp", "css", "html"]
NO_LANGUAGE = "plaintext"

# Fixed value: how the error text of a page without any text block begins; its URL follows.
NO_CONTENT = "Failed to scrape content for "


def code_language(class_name: Column) -> Column:
    names = F.lower(class_name)
    return reduce(
        lambda chain, name: chain.when(names.contains(name), name),
        LANGUAGES[1:],
        F.when(names.contains(LANGUAGES[0]), LANGUAGES[0]),
    ).otherwise(NO_LANGUAGE)


def _clean_blocks(parsed: Column) -> Column:
    """Cleaned, non-empty blocks; several references to the cleaned text cost one evaluation."""
    cleaned = F.transform(
        parsed["blocks"],
        lambda b: F.struct(b["tag"].alias("tag"), clean_text(b["text"]).alias("text")),
    )
    return F.filter(cleaned, lambda b: b["text"] != "")


def text_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, tag, text) for every paragraph, heading, link, list item, div and span."""
    parsed = pages.select("page_id", page_blocks("html").alias("parsed"))
    blocks = parsed.select("page_id", F.posexplode(_clean_blocks(F.col("parsed"))))
    return blocks.select("page_id", "pos", "col.tag", "col.text")


def code_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, language, code, line_numbers) for every code element."""
    parsed = pages.select("page_id", page_blocks("html").alias("parsed"))
    codes = F.transform(
        F.col("parsed.codes"),
        lambda c: F.struct(c["class"].alias("class"), trim_space(c["text"]).alias("code")),
    )
    rows = parsed.select("page_id", F.posexplode(F.filter(codes, lambda c: c["code"] != "")))
    return rows.select(
        "page_id",
        "pos",
        code_language(F.col("col.class")).alias("language"),
        "col.code",
        F.col("col.class").contains("line-numbers").alias("line_numbers"),
    )


def code_languages(codes: DataFrame) -> DataFrame:
    return codes.groupBy("language").agg(F.count("*").alias("n_blocks"))


def distinct_blocks(parsed: Column) -> Column:
    """Cleaned texts of a page, the first of equal ones kept."""
    return F.array_distinct(F.transform(_clean_blocks(parsed), lambda b: b["text"]))


def no_content(url: Column) -> Column:
    """Error text of a page without any text block."""
    return F.concat(F.lit(NO_CONTENT), url)


def all_text(html: Column, first_only: bool = False) -> Column:
    """The distinct blocks of a page, masked, a line each; NULL when there is none."""
    blocks = distinct_blocks(page_blocks(html))
    masked = F.transform(blocks, lambda b: mask_phrases(b, first_only))
    return F.when(F.size(blocks) > 0, F.array_join(masked, "\n"))


def first_text(html: Column) -> Column:
    """The first cleaned block of a page that is not empty; NULL when there is none."""
    return F.get(distinct_blocks(page_blocks(html, first_only=True)), F.lit(0))


def dedup_blocks(pages: DataFrame, first_only: bool = True) -> DataFrame:
    """(page_id, pos, text): distinct blocks of a page, masked after the de-duplication."""
    texts = distinct_blocks(page_blocks("html"))
    rows = pages.select("page_id", F.posexplode(texts).alias("pos", "text"))
    return rows.withColumn("text", mask_phrases(F.col("text"), first_only))


def primary_content(pages: DataFrame, first_only: bool = True) -> DataFrame:
    """(page_id, url, content, error): the first distinct block, masked."""
    first = first_text(F.col("html"))
    content = mask_phrases(F.col("first"), first_only)
    return pages.select("page_id", "url", first.alias("first")).select(
        "page_id",
        "url",
        content.alias("content"),
        F.when(F.col("first").isNull(), no_content(F.col("url"))).alias("error"),
    )


def page_records(pages: DataFrame, base: str, fields: list[dict]) -> DataFrame:
    """Structured extraction: one row per ``base`` element, one column per field."""
    records = pages.select("page_id", records_column(F.col("html"), base, fields).alias("records"))
    rows = records.select("page_id", F.posexplode("records").alias("pos", "record"))
    return rows.select(
        "page_id", "pos", *(F.col("record")[f["name"]].alias(f["name"]) for f in fields)
    )


def markdown(content: Column, url: Column, title: Column, date: Column) -> Column:
    """Page text as Markdown with a front matter; ``date`` is text supplied by the caller."""
    lines = F.transform(F.split(content, "\n"), trim_space)
    lines = F.filter(lines, lambda line: line != "")
    lines = F.transform(
        lines, lambda line: F.when(heading_line(line), F.concat(F.lit("## "), line)).otherwise(line)
    )
    body = F.array_join(lines, "\n\n")
    named = F.when(title != "", title)
    return F.concat(
        F.lit("---\nurl: "), url,
        F.lit("\ndate: "), date,
        F.lit("\ntitle: "), F.coalesce(named, F.lit("Untitled Page")),
        F.lit("\n---\n\n\n# "), F.coalesce(named, F.lit("Page Content")),
        F.lit("\n\n"), body,
        F.lit("\n\n---\n*Generated on: "), date,
        F.lit("*\n*Source: "), url, F.lit("*\n"),
    )
