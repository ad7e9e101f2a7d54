"""Link extraction and URL predicates.

All links of a page come from one row, so extraction, filtering and de-duplication stay inside
that row as array expressions: no shuffle, and a page with very many links is one row's work.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.common import let, trim_space
from webcorpus.functions.urls import (
    SCRIPT_SCHEME,
    absolute_url,
    base_parts,
    canonical_link,
    domain_key,
    is_textual_path,
    is_valid_url,
    normalize_url,
    resolve_link,
    route_of,
    same_site,
    site_key,
    site_of_host,
    url_origin,
    url_path,
)

_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?</\1\s*>"
# A tag up to its end; a quoted ">" does not end it. Possessive, so Java loops instead of recursing.
_TAG = r"""(?is)<{name}(?=[\s/])(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_HREF = (
    r"""(?is)^<[a-z]+(?:[\s/]+(?!href[\s=>/])[^\s=>/]+(?:\s*=\s*(?:"[^"]*+"|'[^']*+'|[^\s>"']++))?)*+"""
    r"""[\s/]+href\s*=\s*("[^"]*+"|'[^']*+'|[^\s>]+)"""
)

# Numeric references, named ones with their semicolon, and the few that work without.
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"
_BARE_REFERENCE = r"^(amp|lt|gt|quot)(?![A-Za-z0-9=;])"
_NAMED = json.dumps({name: chr(code) for name, code in name2codepoint.items()})


def _character(code: Column) -> Column:
    """The character of a code point; NULL when there is none."""
    sound = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with the reference it begins with decoded."""

    def decoded(name: Column) -> Column:
        digits = F.when(name.rlike("^#[xX]"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(
            F.substr(name, F.lit(2))
        )
        char = F.when(name.startswith("#"), let(digits.try_cast("bigint"), _character)).otherwise(
            F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), name)
        )
        rest = F.regexp_replace(F.substr(piece, F.length(name) + 1), "^;", "")
        return F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), piece))

    whole = F.regexp_extract(piece, _REFERENCE, 1)
    return let(F.when(whole != "", whole).otherwise(F.regexp_extract(piece, _BARE_REFERENCE, 1)), decoded)


def _unescape(text: Column) -> Column:
    def decoded(pieces: Column) -> Column:
        rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), _decoded)
        return F.array_join(F.concat(F.slice(pieces, 1, 1), rest), "")

    return F.when(text.contains("&"), let(F.split(text, "&", -1), decoded)).otherwise(text)


def _href_values(html: Column, name: str) -> Column:
    """Decoded ``href`` values of all tags of one name in document order."""
    tags = F.regexp_extract_all(F.regexp_replace(html, _NO_MARKUP, ""), F.lit(_TAG.format(name=name)), 0)
    values = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, _HREF, 1)), lambda v: v != "")
    return F.transform(
        values, lambda v: _unescape(F.regexp_replace(v, r"""^["']|["']\z""", ""))
    )


def hrefs(html: Column) -> Column:
    """Array of the ``a[href]`` values of a page in document order, references decoded."""
    return _href_values(html, "a")


def document_base(html: Column, url: Column) -> Column:
    """``base_parts`` of what a page's links are relative to: its URL, or its first ``base`` tag."""
    own = let(url, base_parts)
    first = F.get(_href_values(html, "base"), F.lit(0))
    stated = let(own, lambda b: let(first, lambda h: resolve_link(h, b)["url"]))
    moved = F.when(html.rlike(r"(?i)<base[\s/]"), stated)
    return F.coalesce(let(moved, lambda m: F.when(m.isNotNull(), base_parts(m))), own)


def page_targets(html: Column, base: Column) -> Column:
    """Resolved targets (struct of url, host, path) of a page, without script-like schemes.

    Equal ``href`` values are resolved once; two spellings of one target both stay.
    """
    targets = F.transform(F.array_distinct(hrefs(html)), lambda h: resolve_link(h, base))
    return F.filter(targets, lambda t: ~F.lower(trim_space(t["url"])).rlike(SCRIPT_SCHEME))


def page_links(html: Column, url: Column, site: Column | None = None) -> Column:
    """Distinct links worth following: same site, textual, in canonical form.

    ``site`` is any URL of the crawled site; by default the page itself.
    """
    page = F.struct(
        document_base(html, url).alias("base"), site_key(url if site is None else site).alias("site")
    )

    def links(p: Column) -> Column:
        kept = F.filter(
            page_targets(html, p["base"]),
            lambda t: (site_of_host(t["host"]) == p["site"]) & is_textual_path(t["path"]),
        )
        return F.array_distinct(F.transform(kept, lambda t: canonical_link(t["url"])))

    return let(page, links)


def extract_links(pages: DataFrame, site: Column | None = None) -> DataFrame:
    """One row per page and link: (page_id, pos, link)."""
    links = page_links(F.col("html"), F.col("url"), site)
    return pages.select("page_id", F.posexplode(links).alias("pos", "link"))


def link_sites(pages: DataFrame) -> DataFrame:
    """Every distinct target of a page with a flag: does it stay on the page's site?"""
    targets = let(
        document_base(F.col("html"), F.col("url")),
        lambda base: F.array_distinct(
            F.transform(page_targets(F.col("html"), base), lambda t: t["url"])
        ),
    )
    rows = pages.select("page_id", "url", F.explode(targets).alias("target"))
    return rows.select(
        "page_id", "target", same_site(F.col("target"), F.col("url")).alias("same_site")
    )


def textual_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose path does not end like an image, document or archive."""
    return urls.filter(is_textual_path(url_path(F.col(url))))


def valid_urls(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.filter(is_valid_url(F.col(url)))


def url_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """All derived URL keys side by side."""
    text = F.col(url)
    return urls.select(
        "*",
        absolute_url(text).alias("absolute"),
        site_key(text).alias("site"),
        url_origin(text).alias("origin"),
        url_path(text).alias("path"),
        domain_key(text).alias("domain"),
        route_of(text).alias("route"),
        normalize_url(text, text).alias("normalized"),
    )


def crawl_batches(pages: DataFrame, size: int = 3) -> DataFrame:
    """Split each page's links into batches of ``size``: (page_id, batch, links)."""
    links = page_links(F.col("html"), F.col("url"))
    count = F.ceil(F.size("links") / F.lit(size)).cast("int")
    starts = F.when(
        F.size("links") > 0, F.sequence(F.lit(0), count - 1)
    ).otherwise(F.array().cast("array<int>"))
    batches = F.transform(
        starts, lambda b: F.struct(b.alias("batch"), F.slice("links", b * size + 1, size).alias("links"))
    )
    return (
        pages.select("page_id", links.alias("links"))
        .select("page_id", F.inline(batches))
    )
