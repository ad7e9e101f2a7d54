"""SQL fragments shared by the checks."""

from webcorpus.plans import derived

_TABLES = {n: n for n in ("documents", "pages", "labels", "part", "embeddings")}


def view(sql: str) -> str:
    return sql.format(**_TABLES)


URLS = view(derived.URLS)
RAW_URLS = view(derived.RAW_URLS)
TEXTS = view(derived.TEXTS)
MIXED = view(derived.PAGES)
RESULTS = view(derived.RESULTS)
EDGES = view(derived.EDGES)
SITE = view(derived.SITE)
PRIOR = view(derived.PRIOR)
BLOCKLIST = view(derived.BLOCKLIST)
LEXICON = view(derived.LEXICON)
RULES = view(derived.RULES)
ENGLISH = view(derived.ENGLISH)
VERDICTS = view(derived.VERDICTS)
TEMPLATES = derived.TEMPLATES
RESPONSES = view(derived.RESPONSES)
CATALOGUE = view(derived.CATALOGUE)
VECTORS = view(derived.VECTORS)

# Whitespace as browsers see it, as the body of an RE2 character class.
SPACE_SET = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACE = f"[{SPACE_SET}]"


def host(url: str) -> str:
    """Lower-case host of a plain http(s) URL without user or port."""
    return f"lower(regexp_extract({url}, '^[a-zA-Z]+://([^/?#:]*)', 1))"


def bare(text: str) -> str:
    return f"CASE WHEN starts_with({text}, 'www.') THEN substr({text}, 5) ELSE {text} END"


def path(url: str) -> str:
    """Path of a plain http(s) URL, '/' when empty."""
    return f"coalesce(nullif(regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), ''), '/')"


def encoded(text: str) -> str:
    """Non-ASCII and unsafe characters percent-encoded."""
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c:"
        " CASE WHEN regexp_matches(c, '[^!#-;=?-_a-z|~]') THEN url_encode(c) ELSE c END), '')"
    )


def route(path_sql: str) -> str:
    key = f"regexp_replace({path_sql}, '\\.(html?|php|aspx?|jsp)$', '', 'i')"
    key = f"regexp_replace({key}, '^/|/$', '', 'g')"
    key = f"regexp_replace({key}, '[^a-zA-Z0-9]', '-', 'g')"
    key = f"regexp_replace({key}, '-+', '-', 'g')"
    key = f"lower(regexp_replace({key}, '-$', ''))"
    return f"coalesce(nullif({key}, ''), 'root')"


def route_of(url: str) -> str:
    return route(path(url))


def canonical(url: str) -> str:
    cut = f"regexp_replace(regexp_replace({url}, '/$', ''), '^http:', 'https:')"
    return (
        f"CASE WHEN starts_with({cut}, 'https://www.') THEN {cut}"
        f" ELSE replace({cut}, 'https://', 'https://www.') END"
    )


def domain_key(text: str) -> str:
    return f"split_part(regexp_replace(lower({text}), '^(https?://)?(www\\.)?', ''), '/', 1)"


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def clean(text: str) -> str:
    ascii_only = f"regexp_replace({trim(text)}, '[^\\x00-\\x7F]', '', 'g')"
    return f"regexp_replace({ascii_only}, '[\\s\\x0B]+', ' ', 'g')"


MASKS = [
    r"\b(?:p[o0]rn(?:ography)?|xxx)\b",
    rf"\b(?:18\+{SPACE}*(?:explicit|content|only))\b",
    rf"\b(?:escort{SPACE}*service|cam{SPACE}*(?:girl|model|show))\b",
]


def mask(text: str, flags: str = "i") -> str:
    for pattern in MASKS:
        text = f"regexp_replace({text}, '{pattern}', ' ', '{flags}')"
    return text


def unescape(text: str) -> str:
    for name, char in (("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


def pretty(n: str) -> str:
    """Three significant digits; a double that is exactly half-way rounds up."""
    unit = f"CASE WHEN {n} < 1e6 THEN 1 WHEN {n} < 1e9 THEN 2 WHEN {n} < 1e12 THEN 3 WHEN {n} < 1e15 THEN 4 WHEN {n} < 1e18 THEN 5 ELSE 6 END"
    u = f"CAST(pow(1000, {unit}) AS HUGEINT)"
    scale = f"CASE WHEN {n} >= 100 * {u} THEN 0 WHEN {n} >= 10 * {u} THEN 1 ELSE 2 END"
    step = f"({u} // CAST(pow(10, {scale}) AS HUGEINT))"
    low = f"({n} // {step})"
    exact = f"CAST(CAST({n} AS DOUBLE) / CAST({u} AS DOUBLE) * 4503599627370496.0 AS HUGEINT)"
    up = f"CASE WHEN {exact} * {u} >= ({low} * {step} + {step} // 2) * 4503599627370496 THEN 1 ELSE 0 END"
    number = f"CAST(CAST({low} + {up} AS DOUBLE) / pow(10, {scale}) AS DECIMAL(12, 2))::VARCHAR"
    return (
        f"CASE WHEN {n} < 1000 THEN concat({n}, ' B') ELSE concat("
        f"regexp_replace({number}, '\\.?0+$', ''), ' ', ['kB', 'MB', 'GB', 'TB', 'PB', 'EB'][{unit}]) END"
    )
