"""Checks for sources, link jobs and URL keys."""

from oracles.parts import (
    BLOCKLIST,
    RAW_URLS,
    URLS,
    bare,
    canonical,
    domain_key,
    encoded,
    host,
    path,
    pretty,
    route,
    route_of,
    unescape,
)

_LINKS = f"""
raw AS (
  SELECT page_id, url, {host('url')} AS host, h.href, h.i
  FROM pages, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) WITH ORDINALITY AS h(href, i)
),
links AS (
  SELECT page_id, min(i) AS i, {canonical(f"concat('https://', host, {encoded(unescape('href'))})")} AS link
  FROM raw
  WHERE NOT regexp_matches(href, '(?i)\\.(jpg|jpeg|png|gif|svg|pdf|doc|docx|xls|xlsx|zip|rar)$')
  GROUP BY page_id, link
)
"""

# What each kind of derived page links to, straight from its definition.
_MIXED_TARGETS = f"""
base AS (
  SELECT doc_id AS page_id, url, split_part(url, '://', 1) AS scheme, {host('url')} AS host,
    regexp_replace(regexp_extract({path('url')}, '^(.*/)', 1), '[^/]+/$', '') AS up
  FROM ({URLS}) u
),
targets AS (
  SELECT page_id, url, host, 0 AS i, host AS target_host,
    concat(scheme, '://', host, '/docs/', page_id % 17, '/') AS target FROM base
  UNION ALL
  SELECT page_id, url, host, 1, host,
    concat(scheme, '://', host, up, 'up/', page_id % 11, '.html#sec') FROM base
  UNION ALL
  SELECT page_id, url, host, 2, '', 'mailto:x@example.org' FROM base
  UNION ALL
  SELECT page_id, url, host, 3, concat('www.h', page_id % 13, '.example.org'),
    concat('http://www.h', page_id % 13, '.example.org/b?x=1&y=', page_id) FROM base
  UNION ALL
  SELECT page_id, url, host, 4, host, concat(scheme, '://', host, '/files/', page_id, '.PDF')
  FROM base
  UNION ALL
  SELECT page_id, url, host, 5, host, concat(scheme, '://', host, '/gt/', page_id % 19) FROM base
  UNION ALL
  SELECT page_id, url, host, 6, host, concat(scheme, '://', host, '/x?a=1&b=caf%C3%A9') FROM base
)
"""
_MIXED_LINKS = f"""
{_MIXED_TARGETS},
mixed AS (
  SELECT page_id, i, {canonical('target')} AS link FROM targets
  WHERE {bare('host')} = {bare('target_host')} AND i <> 4
)
"""

SQL = {
    "scan_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages",
    "load_blocklist": f"SELECT DISTINCT {domain_key('url')} AS domain FROM ({BLOCKLIST}) b",
    "extract_links": f"""
WITH {_LINKS}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, link FROM links
""",
    "extract_links_mixed": f"""
WITH {_MIXED_LINKS}
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, link FROM mixed
""",
    "same_site_links": f"""
WITH {_MIXED_TARGETS}
SELECT page_id, target, {bare('host')} = {bare('target_host')} AS same_site FROM targets
""",
    "crawl_batches": f"""
WITH {_LINKS},
numbered AS (
  SELECT page_id, link, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n FROM links
)
SELECT page_id, n // 3 AS batch, string_agg(link, '|' ORDER BY n) AS links
FROM numbered GROUP BY page_id, n // 3
""",
    "textual_urls": f"""
SELECT doc_id, url FROM ({URLS}) u
WHERE lower(regexp_extract({path('url')}, '\\.([a-zA-Z]+)$', 1)) NOT IN
  ('jpg', 'jpeg', 'png', 'gif', 'svg', 'pdf', 'doc', 'docx', 'xls', 'xlsx', 'zip', 'rar')
""",
    "valid_urls": f"""
SELECT doc_id, url FROM ({RAW_URLS}) u
WHERE doc_id % 9 IN (0, 3, 5, 8) OR (doc_id % 9 = 7 AND 65000 + doc_id % 1000 < 65536)
  OR (doc_id % 9 = 4 AND doc_id % 7 = 3)
""",
    "restricted_urls": f"""
WITH all_urls AS (
  SELECT doc_id, url FROM ({URLS}) u UNION ALL SELECT -page_id - 1, url FROM pages
),
keyed AS (SELECT *, {domain_key('url')} AS d FROM all_urls)
SELECT doc_id, url,
  d IN (SELECT {domain_key('url')} FROM ({BLOCKLIST}) b)
    OR regexp_matches(d, '\\.(xxx|sex|adult|porn)$') OR regexp_matches(d, '^(porn|xxx|adult|sex)[-.]')
    AS restricted
FROM keyed
""",
    "restricted_redirects": f"""
WITH keyed AS (SELECT doc_id, url, {domain_key('url')} AS d FROM ({URLS}) u),
flagged AS (
  SELECT *, d IN (SELECT {domain_key('url')} FROM ({BLOCKLIST}) b)
    OR regexp_matches(d, '\\.(xxx|sex|adult|porn)$') AS bad FROM keyed
)
SELECT a.doc_id, a.url, coalesce(b.url, a.url) AS final_url,
  CASE WHEN a.bad OR b.bad THEN 'Domain contains restricted content' END AS error
FROM flagged a LEFT JOIN flagged b ON a.doc_id = b.doc_id + 1
""",
    "frontier_unseen": f"""
WITH {_LINKS}, {_MIXED_LINKS}
SELECT DISTINCT link FROM (SELECT link FROM mixed UNION ALL SELECT link FROM links) x
WHERE link NOT IN (SELECT link FROM mixed WHERE contains(link, 'docs/1'))
""",
    "url_parts": f"""
SELECT doc_id, url, url AS absolute, {bare(host('url'))} AS site,
  regexp_extract(url, '^[a-z]+://[^/]*') AS origin, {path('url')} AS path,
  {bare(host('url'))} AS domain, {route_of('url')} AS route, {canonical('url')} AS normalized
FROM ({URLS}) u
""",
    "page_routes": f"""
SELECT page_id, true AS valid, {route(encoded(path('url')))} AS route FROM pages
""",
    "pretty_sizes": f"""
SELECT n, {pretty('n')} AS size
FROM (
  SELECT DISTINCT (l_orderkey * 7919 % 1000003) * CAST(pow(10, l_orderkey % 12) AS BIGINT) + l_partkey % 1000 AS n
  FROM lineitem
) s
""",
}
