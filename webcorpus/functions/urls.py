"""URL arithmetic as Column expressions.

The grammar is the generic-syntax split of RFC 3986 plus the browser's rules for http(s):
lower-case scheme and host, no default port, dot segments removed, non-ASCII and unsafe
characters percent-encoded as UTF-8. Punycode hosts and backslashes are not handled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webcorpus.functions.common import let

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?\z"
_SPECIAL = r"(?i)^(?:https?|wss?|ftp):"
_ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_HOST_CHAR = r"[^\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
_PORT = (
    r"0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])?"
)
_AUTHORITY = rf"//(?:[^/?#@]*@)?(?:\[[0-9a-f:.]+\]|{_HOST_CHAR}+)(?::{_PORT})?"
_SPECIAL_OK = rf"(?i)^(?:https?|wss?|ftp):{_AUTHORITY}(?:[/?#]|\z)"
_DOT_SEGMENT = r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|\z)"

# Characters that are percent-encoded in each part of a URL.
_ENCODE_PATH = r"[\x00-\x20\"<>`{}\x7F-\x{10FFFF}]"
_ENCODE_QUERY = r"[\x00-\x20\"<>'\x7F-\x{10FFFF}]"
_ENCODE_FRAGMENT = r"[\x00-\x20\"<>`\x7F-\x{10FFFF}]"

# Fixed value: path endings of files that carry no page text.
NON_TEXT_SUFFIX = r"(?i)\.(?:jpg|jpeg|png|gif|svg|pdf|doc|docx|xls|xlsx|zip|rar)\z"
# Fixed value: page extensions left out of a route key.
PAGE_SUFFIX = r"(?i)\.(?:html?|php|aspx?|jsp)\z"
# Runs of other characters than ASCII letters and digits; spelled as what it is, since Java scans
# negated classes of several ranges some fifteen times slower.
_NOT_ALNUM = r"[\x00-/:-@\[-`{-\x{10FFFF}]+"
# Fixed value: link schemes that never name a page.
SCRIPT_SCHEME = r"^(?:javascript|data|vbscript):"


def tidy_url(url: Column) -> Column:
    """Drop what a URL parser ignores: control/space at the ends, tabs and newlines anywhere."""
    tidied = F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z|[\t\n\r]+", "")
    return F.when(url.rlike(r"[\x00-\x20]"), tidied).otherwise(url)


def _parts(url: Column) -> Column:
    """Struct of the raw parts; each keeps its delimiter, '' when absent."""
    return F.struct(
        F.lower(F.regexp_extract(url, _SPLIT, 1)).alias("scheme"),
        F.regexp_extract(url, _SPLIT, 2).alias("authority"),
        F.regexp_extract(url, _SPLIT, 3).alias("path"),
        F.regexp_extract(url, _SPLIT, 4).alias("query"),
        F.regexp_extract(url, _SPLIT, 5).alias("fragment"),
    )


def _encode(text: Column, unsafe: str) -> Column:
    encoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit("(?s)(.)"), 1),
            lambda c: F.when(
                c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
            ).otherwise(c),
        ),
        "",
    )
    return F.when(text.rlike(unsafe), encoded).otherwise(text)


def _without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments of a path that starts with '/'."""

    def is_up(segment: Column) -> Column:
        return segment.rlike(r"(?i)^(?:\.|%2e){2}\z")

    def is_here(segment: Column) -> Column:
        return segment.rlike(r"(?i)^(?:\.|%2e)\z")

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(is_up(segment), F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(is_here(segment), kept)
            .otherwise(F.concat(kept, F.array(segment)))
        )

    segments = F.split(F.substring(path, 2, 2**31 - 1), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    ends_in_dots = path.rlike(r"(?i)/(?:\.|%2e){1,2}\z")
    tail = F.when(ends_in_dots, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    # Most paths are settled by plain substrings.
    dotted = (path.contains("/.") | path.contains("/%2")) & path.rlike(_DOT_SEGMENT)
    return F.when(
        dotted, F.concat(F.lit("/"), F.array_join(F.concat(kept, tail), "/"))
    ).otherwise(path)


def _clean_path(path: Column) -> Column:
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return let(rooted, lambda p: _encode(_without_dots(p), _ENCODE_PATH))


def _host(authority: Column) -> Column:
    return F.lower(F.regexp_extract(authority, r"^//(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def _clean_authority(scheme: Column, authority: Column) -> Column:
    user = F.regexp_extract(authority, r"^//([^@]*@)", 1)
    port = F.regexp_extract(authority, r"(:[0-9]+)\z", 1)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443"))
    return F.concat(
        F.lit("//"), user, _host(authority), F.when(default, "").otherwise(port)
    )


def _finish(p: Column) -> Column:
    """Serialise split parts of an http(s) URL: struct of url, host and path."""
    return let(
        _clean_path(p["path"]),
        lambda path: F.struct(
            F.concat(
                p["scheme"],
                F.lit(":"),
                _clean_authority(p["scheme"], p["authority"]),
                path,
                _encode(p["query"], _ENCODE_QUERY),
                _encode(p["fragment"], _ENCODE_FRAGMENT),
            ).alias("url"),
            _host(p["authority"]).alias("host"),
            path.alias("path"),
        ),
    )


def is_valid_url(url: Column) -> Column:
    """True when the text is an absolute URL; false for NULL."""
    text = tidy_url(url)
    ok = text.rlike(_SPECIAL_OK) | (text.rlike(_ABSOLUTE) & ~text.rlike(_SPECIAL))
    return F.coalesce(ok, F.lit(False))


def base_parts(url: Column) -> Column:
    """What :func:`resolve_link` needs of a page URL; compute it once per page."""
    return _parts(tidy_url(url))


def resolve_link(href: Column, base: Column) -> Column:
    """Resolve ``href`` against ``base_parts``: struct of url, host and path, NULL when invalid."""

    def target(h: Column) -> Column:
        def parts(authority, path, query):
            return F.struct(
                base["scheme"].alias("scheme"),
                authority.alias("authority"),
                path.alias("path"),
                query.alias("query"),
                h["fragment"].alias("fragment"),
            )

        folder = F.regexp_extract(base["path"], r"^(.*/)", 1)
        nearby = F.concat(F.when(folder == "", "/").otherwise(folder), h["path"])
        same_query = F.when(h["query"] != "", h["query"]).otherwise(base["query"])
        return (
            F.when(h["scheme"] != "", h)
            .when(h["authority"] != "", parts(h["authority"], h["path"], h["query"]))
            .when(h["path"] == "", parts(base["authority"], base["path"], same_query))
            .when(h["path"].startswith("/"), parts(base["authority"], h["path"], h["query"]))
            .otherwise(parts(base["authority"], nearby, h["query"]))
        )

    def finish(h: Column) -> Column:
        opaque = F.struct(
            F.concat(h["scheme"], F.lit(":"), h["authority"], h["path"], h["query"], h["fragment"])
            .alias("url"),
            _host(h["authority"]).alias("host"),
            h["path"].alias("path"),
        )
        web = let(
            target(h),
            lambda t: F.when(
                t["scheme"].isin("http", "https") & t["authority"].rlike(rf"(?i)^{_AUTHORITY}\z"),
                _finish(t),
            ),
        )
        is_web = h["scheme"].isin("", "http", "https")
        is_special = h["scheme"].isin("ws", "wss", "ftp")
        valid = ~is_special | h["authority"].rlike(rf"(?i)^{_AUTHORITY}\z")
        return F.when(is_web, web).when(valid, opaque)

    return let(_parts(tidy_url(href)), finish)


def _no_base() -> Column:
    return _parts(F.lit(""))


def absolute_url(url: Column) -> Column:
    """Serialised form of an absolute URL; NULL when it is not one."""
    return resolve_link(url, _no_base())["url"]


def resolve_url(href: Column, base: Column) -> Column:
    """Resolve ``href`` against the absolute URL ``base`` and serialise the result."""
    return let(base_parts(base), lambda b: resolve_link(href, b))["url"]


def host_name(url: Column) -> Column:
    """Lower-case host without user and port; '' for schemes without one, NULL when invalid."""
    return F.when(is_valid_url(url), _host(F.regexp_extract(tidy_url(url), _SPLIT, 2)))


def site_of_host(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def site_key(url: Column) -> Column:
    """Host that identifies a site: one leading ``www.`` dropped."""
    return site_of_host(host_name(url))


def same_site(left: Column, right: Column) -> Column:
    return F.coalesce(site_key(left) == site_key(right), F.lit(False))


def url_origin(url: Column) -> Column:
    """Scheme, host and non-default port."""
    return F.regexp_extract(absolute_url(url), r"^([A-Za-z]+://[^/?#]*)", 1)


def url_path(url: Column) -> Column:
    """Percent-encoded path, '/' when empty; NULL when the URL is invalid."""
    path = F.regexp_extract(tidy_url(url), _SPLIT, 3)
    return F.when(is_valid_url(url), _clean_path(path))


def is_textual_path(path: Column) -> Column:
    return ~path.rlike(NON_TEXT_SUFFIX)


def canonical_link(url: Column) -> Column:
    """Canonical form of a serialised URL: https, ``www.`` host, one trailing slash dropped."""
    text = F.regexp_replace(url, r"/\z", "")
    text = F.regexp_replace(text, r"^http:", "https:")
    return F.regexp_replace(text, r"^https://(?!www\.)", "https://www.")


def normalize_url(url: Column, base: Column) -> Column:
    """Canonical form of a link found on ``base``.

    NULL for fragments, mailto/tel/javascript links and text that is no URL.
    """
    full = (
        F.when(url.startswith("//"), absolute_url(F.concat(F.lit("https:"), url)))
        .when(url.contains("://"), absolute_url(url))
        .otherwise(resolve_url(url, base))
    )
    skipped = url.startswith("#") | url.rlike(r"(?i)^(?:mailto|tel|javascript):")
    return F.when(~skipped, canonical_link(full))


def domain_key(text: Column) -> Column:
    """Key for blocklist lookups: scheme and ``www.`` dropped, cut at the first slash."""
    bare = F.regexp_replace(F.lower(text), r"^(?:https?://)?(?:www\.)?", "")
    return F.substring_index(bare, "/", 1)


def route_key(path: Column) -> Column:
    """Storage key of a path; 'root' when nothing is left."""
    key = F.regexp_replace(path, PAGE_SUFFIX, "")
    key = F.regexp_replace(key, r"^/|/\z", "")
    key = F.regexp_replace(key, _NOT_ALNUM, "-")
    key = F.lower(F.regexp_replace(key, r"-\z", ""))
    return F.coalesce(F.nullif(key, F.lit("")), F.lit("root"))


def route_of(url: Column) -> Column:
    return route_key(url_path(url))
