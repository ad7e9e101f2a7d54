"""Content signals, page types and prompts, computed within each row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.urls import url_path
from webcorpus.operators.joins import lookup_join

# Tags whose pairs count as structure.
STRUCTURES = {
    "structured": ("h[1-6]", "h[1-6]"),
    "list": ("(?:ul|ol)", "(?:ul|ol)"),
    "data": ("table", "table"),
}
# Fixed value: length up to which markup is searched for structure when a scan limit is wanted.
SCAN_LIMIT = 100_000

# Page types in order of priority, with the path fragments and signals that select
# them and the context they stand for (length, structure, audience).
PAGE_TYPES = [
    ("article", ["/article", "/blog", "/news", "/post"],
     ["article", "published", "author", "date", "comments"],
     ("detailed", "narrative", "general")),
    ("product", ["/product", "/item", "/shop"],
     ["price", "buy", "cart", "stock", "shipping"],
     ("standard", "descriptive", "general")),
    ("category", ["/category", "/department", "/section"],
     ["list", "filter", "sort", "categories"],
     ("brief", "analytical", "general")),
    ("profile", ["/profile", "/user", "/about"],
     ["bio", "contact", "experience", "portfolio"],
     ("standard", "descriptive", "general")),
]
GENERAL = ("general", ("standard", "descriptive", "general"))

PLACEHOLDER = "{content}"
DEFAULT_TEMPLATE = "{content}"


def content_signals(
    content: Column, scan_limit: int | None = None, body_limit: int | None = None
) -> Column:
    """Array of the signals a page shows.

    The whole text is searched, and any pair of tags counts. ``scan_limit`` restricts the search
    for pairs to the first characters (``SCAN_LIMIT`` is the usual bound for interactive use),
    ``body_limit`` the characters between the tags.
    """
    scanned = content if scan_limit is None else F.substring(content, 1, scan_limit)
    lowered = F.lower(content)
    body = ".*" if body_limit is None else f".{{0,{body_limit}}}?"

    def pair(opened: str, closed: str) -> Column:
        # Texts without an end tag are settled before any start tag is followed to the end.
        ends = scanned.rlike(rf"(?i)</{closed}>")
        return ends & scanned.rlike(rf"(?is)<{opened}(?:\s[^>]*)?>{body}</{closed}>")

    shapes = [F.when(pair(*tags), name) for name, tags in STRUCTURES.items()]
    words = [
        F.when(lowered.contains("price") | content.rlike(r"\$[0-9]"), "price"),
        F.when(lowered.contains("author") | lowered.contains("posted by"), "article"),
        F.when(lowered.contains("profile") | lowered.contains("about me"), "bio"),
    ]
    return F.array_compact(F.array(*shapes, *words))


def _context(page_type: str, rest: tuple[str, str, str]) -> Column:
    names = ["page_type", "content_length", "structure_type", "target_audience"]
    return F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (page_type, *rest))))


def page_context(path: Column, signals: Column) -> Column:
    """Struct of page type, content length, structure and audience: the first type that fits."""
    chain = None
    for page_type, fragments, words, rest in PAGE_TYPES:
        fits = reduce(or_, (path.contains(f) for f in fragments)) | F.arrays_overlap(
            signals, F.array(*(F.lit(w) for w in words))
        )
        value = _context(page_type, rest)
        chain = F.when(fits, value) if chain is None else chain.when(fits, value)
    return chain.otherwise(_context(*GENERAL))


def classify_pages(pages: DataFrame, url: str, content: str, scan_limit: int | None = None):
    """Add ``signals`` and the four context columns."""
    return (
        pages.withColumn("signals", content_signals(F.col(content), scan_limit))
        .withColumn("_context", page_context(url_path(F.col(url)), F.col("signals")))
        .select("*", "_context.*")
        .drop("_context")
    )


def page_type_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("page_type").agg(F.count("*").alias("n_pages"))


def build_prompts(
    classified: DataFrame,
    content: str,
    templates: DataFrame,
    row_id: str,
    default: str = DEFAULT_TEMPLATE,
) -> DataFrame:
    """Add ``prompt``: the template of the page's type and structure with the content inserted.

    ``templates`` is (page_type, structure_type, template); pages without one get ``default``. The
    content goes in literally, at the first placeholder.
    """
    keys = ["page_type", "structure_type"]
    lookup = templates.select(*keys, F.col("template").alias("_template"))
    joined = lookup_join(classified, lookup, keys, spread_by=row_id)
    chosen = F.coalesce("_template", F.lit(default))
    head = F.substring_index(chosen, PLACEHOLDER, 1)
    tail = F.when(
        F.instr(chosen, PLACEHOLDER) > 0,
        F.concat(F.col(content), F.substr(chosen, F.length(head) + 1 + len(PLACEHOLDER))),
    ).otherwise("")
    return joined.withColumn("prompt", F.concat(head, tail)).drop("_template")
