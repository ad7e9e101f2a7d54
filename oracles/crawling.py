"""Checks for traversal, stores, reports, request logs and streams."""

from oracles.content import _BLOCKS
from oracles.parts import (
    CATALOGUE,
    EDGES,
    PRIOR,
    RESULTS,
    SITE,
    TEXTS,
    URLS,
    canonical,
    encoded,
    mask,
    path,
    pretty,
    route,
    route_of,
    unescape,
)

_ORDER = "length(url), url, doc_id"
_PRIOR_ROUTES = f"SELECT {route_of('url')} FROM ({PRIOR}) p"

_KNOWN = f"""
edges AS ({EDGES}),
nodes AS (
  SELECT page_id AS node, right({route(encoded(path('url')))}, 2) AS route,
    CASE WHEN page_id % 17 = 5 THEN 'failed' WHEN page_id % 11 = 4 THEN 'no_content' ELSE 'ok' END AS status
  FROM pages
),
level0 AS (SELECT page_id AS node FROM pages WHERE contains(url, 'page=2')),
taken0 AS (SELECT route FROM nodes WHERE false),
seen0 AS (SELECT node FROM level0)
"""


_SITE = f"""
site AS (
  SELECT page_id, concat('https://www.corpus.example', {path('url')}) AS node,
    {route(path('url'))} AS route, html FROM ({SITE}) s
),
{_BLOCKS},
links AS (
  SELECT DISTINCT node AS src, {canonical(f"concat('http://corpus.example', {encoded(unescape('href'))})")} AS dst
  FROM site, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h(href)
  WHERE NOT regexp_matches(href, '(?i)\\.(jpg|jpeg|png|gif|svg|pdf|doc|docx|xls|xlsx|zip|rar)$')
),
edges AS (SELECT * FROM links),
site_blocks AS (
  SELECT page_id, 1 AS ord, concat('Page ', page_id, CASE WHEN page_id % 7 = 0 THEN ' xxx' ELSE '' END) AS text FROM pages
  UNION ALL SELECT page_id, 2, 'x' FROM pages
  UNION ALL SELECT page_id, 3, 'gone' FROM pages
  UNION ALL SELECT page_id, 4, 'void' FROM pages
  UNION ALL SELECT page_id, ord, text FROM shown
),
site_firsts AS (SELECT page_id, text, min(ord) AS ord FROM site_blocks GROUP BY page_id, text),
site_texts AS (
  SELECT page_id, string_agg({mask('text', 'gi')}, chr(10) ORDER BY ord) AS content FROM site_firsts GROUP BY page_id
),
nodes AS (
  SELECT node, page_id, route, CASE WHEN page_id < 0 THEN 'no_content' ELSE 'ok' END AS status,
    content
  FROM site LEFT JOIN site_texts USING (page_id)
),
level0 AS (SELECT node FROM site WHERE page_id IN (SELECT page_id FROM pages WHERE contains(url, 'page=2'))),
taken0 AS (SELECT route FROM nodes WHERE false),
seen0 AS (SELECT node FROM level0)
"""


def _levels(depth: int, known: str = _KNOWN) -> str:
    parts = [known]
    for d in range(depth + 1):
        parts.append(f"""
owners{d} AS (
  SELECT route, min(node) AS owner FROM level{d} JOIN nodes USING (node)
  WHERE status = 'ok' AND route NOT IN (SELECT route FROM taken{d}) GROUP BY route
),
done{d} AS (
  SELECT node, route, {d} AS depth, CASE WHEN route IN (SELECT route FROM taken{d}) THEN 'reused'
    WHEN coalesce(status, 'missing') <> 'ok' THEN coalesce(status, 'missing')
    WHEN node = owner THEN 'stored' ELSE 'reused' END AS outcome
  FROM level{d} LEFT JOIN nodes USING (node) LEFT JOIN owners{d} USING (route)
)""")
        if d < depth:
            parts.append(f"""
taken{d + 1} AS (SELECT route FROM taken{d} UNION SELECT route FROM owners{d}),
level{d + 1} AS (
  SELECT DISTINCT dst AS node FROM edges
  WHERE src IN (SELECT node FROM done{d} WHERE outcome IN ('stored', 'no_content'))
    AND dst NOT IN (SELECT node FROM seen{d})
),
seen{d + 1} AS (SELECT node FROM seen{d} UNION SELECT node FROM level{d + 1})""")
    return ",".join(parts)


def _throttle(key: str, capacity: int, rate: float) -> str:
    have = f"least({capacity}, r.tokens + CAST(floor((e.ms - r.ms) * {rate!r}::DOUBLE / 1000.0::DOUBLE) AS BIGINT))"
    return f"""
RECURSIVE e AS (
  SELECT event_id, {key} AS k, (epoch_us(ts) // 1000) AS ms,
    row_number() OVER (PARTITION BY {key} ORDER BY (epoch_us(ts) // 1000), event_id) AS n
  FROM events
),
run AS (
  SELECT event_id, k, ms, n, {capacity} - 1 AS tokens, true AS admitted FROM e WHERE n = 1
  UNION ALL
  SELECT e.event_id, e.k, e.ms, e.n, greatest({have} - 1, 0), {have} > 0
  FROM run r JOIN e ON e.k = r.k AND e.n = r.n + 1
)
"""


def _gaps(key: str) -> str:
    return f"""
timed AS (SELECT event_id, {key} AS k, (epoch_us(ts) // 1000) AS ms FROM events),
gaps AS (
  SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY k ORDER BY ms, event_id) > 3600000, true) AS opens
  FROM timed
),
numbered AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY k ORDER BY ms, event_id) AS session FROM gaps
),
sessions AS (
  SELECT k AS user_id, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n_requests
  FROM numbered GROUP BY k, session
)
"""


_HOURLY = """
SELECT event_type, (epoch_us(ts) // 1000) // 3600000 * 3600000 AS start_ms,
  (epoch_us(ts) // 1000) // 3600000 * 3600000 + 3600000 AS end_ms, count(*) AS n_requests
FROM events GROUP BY ALL HAVING count(*) > 3
"""

_LISTS = f"""
routed AS (SELECT doc_id, {route_of('url')} AS route, url FROM ({RESULTS}) r),
sized AS (SELECT route, (count(*) + 9) // 10 AS parts FROM routed GROUP BY route),
lists AS (
  SELECT route, CAST(CONCAT('0x', substr(md5(concat(url, '#', doc_id)), 1, 8)) AS BIGINT) % parts AS part,
    list(url ORDER BY url) AS urls
  FROM routed JOIN sized USING (route) GROUP BY ALL
)
"""


SQL = {
    "reuse_existing": f"""
WITH routed AS (SELECT doc_id, {route_of('url')} AS route FROM ({URLS}) u)
SELECT doc_id, route, route IN ({_PRIOR_ROUTES}) AS reused FROM routed
""",
    "sink_content": f"""
WITH routed AS (
  SELECT u.doc_id, u.url, {route_of('u.url')} AS route, t.text AS content,
    CASE WHEN u.doc_id % 4 = 0 THEN '' ELSE {mask('t.text')} END AS processed
  FROM ({URLS}) u JOIN ({TEXTS}) t ON t.doc_id = u.doc_id
),
kinds AS (
  SELECT doc_id, url, route, 'content' AS kind, content AS body FROM routed
  UNION ALL SELECT doc_id, url, route, 'processed', processed FROM routed
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY route, kind ORDER BY {_ORDER}) AS n FROM kinds
  WHERE body <> '' AND NOT (kind = 'content' AND route IN ({_PRIOR_ROUTES}))
)
SELECT route, kind, url, md5(body) AS body_md5 FROM ranked WHERE n = 1
""",
    "sink_content_rerun": f"""
SELECT DISTINCT {route_of('url')} AS route, 'content' AS kind, 1::BIGINT AS n
FROM ({URLS}) u JOIN documents d ON d.doc_id = u.doc_id WHERE d.text <> ''
""",
    "export_json": f"""
SELECT concat('["', url, '",{{"url":"', url, '"',
  CASE WHEN error IS NOT NULL THEN concat(',"error":"', error, '"') ELSE '' END,
  ',"content_size":', content_size, ',"found_links":', found_links,
  CASE WHEN processing_ms IS NOT NULL THEN concat(',"processing_ms":', processing_ms) ELSE '' END,
  '}}]') AS value
FROM ({RESULTS}) r
""",
    "export_csv": f"""
SELECT concat(url, ',', CASE WHEN error IS NULL THEN 'Success' ELSE 'Failed' END, ',',
  nullif(content_size, 0), ',', nullif(processing_ms, 0), ',', nullif(found_links, 0), ',', error) AS value
FROM ({RESULTS}) r
""",
    "export_markdown": f"""
SELECT concat(url, '|', CASE WHEN error IS NULL THEN '✅ Success' ELSE '❌ Failed' END, '|',
  CASE WHEN content_size > 0 THEN {pretty('content_size')} ELSE '-' END, '|',
  coalesce(nullif(processing_ms, 0)::VARCHAR || 'ms', '-'), '|',
  coalesce(nullif(found_links, 0)::VARCHAR, '-'), '|', coalesce(error, '-')) AS value
FROM ({RESULTS}) r
""",
    "results_table": f"""
SELECT url, CASE WHEN error IS NULL THEN 'Success' ELSE 'Failed' END AS status,
  CASE WHEN error IS NULL THEN {pretty('content_size')} ELSE '-' END AS size,
  CASE WHEN error IS NULL THEN concat(coalesce(processing_ms, 0), 'ms') ELSE '-' END AS processing_time,
  CASE WHEN error IS NULL THEN found_links::VARCHAR ELSE '-' END AS links_found
FROM ({RESULTS}) r
""",
    "crawl_report": f"""
WITH {_LISTS}
SELECT 'totals' AS section, concat('{{"total":', count(*), ',"successful":', count(*) - count(error),
  ',"failed":', count(error), '}}') AS value FROM ({RESULTS}) r
UNION ALL
SELECT 'failed', concat('{{"url":"', url, '","error":"', error, '"}}') FROM ({RESULTS}) r WHERE error IS NOT NULL
UNION ALL
SELECT 'route', concat('{{"route":"', route, '","part":', part, ',"urls":["', array_to_string(urls, '","'), '"]}}')
FROM lists
""",
    "crawl_bfs": f"""
WITH RECURSIVE edges AS ({EDGES}),
walk AS (
  SELECT page_id AS node, CAST(0 AS BIGINT) AS depth FROM pages WHERE contains(url, 'page=2')
  UNION
  SELECT dst, depth + 1 FROM walk JOIN edges ON src = node WHERE depth < 3
)
SELECT node, min(depth) AS depth FROM walk GROUP BY node
""",
    "crawl_routes": f"""
WITH {_levels(3)}
{' UNION ALL '.join(f'SELECT node, depth::BIGINT AS depth, outcome FROM done{d}' for d in range(4))}
""",
    "crawl_site": f"""
WITH {_levels(3, _SITE)},
done AS ({' UNION ALL '.join(f'SELECT * FROM done{d}' for d in range(4))})
SELECT d.node AS url, d.route, d.depth::BIGINT AS depth, outcome,
  CASE outcome WHEN 'missing' THEN 'Page is not in the corpus'
    WHEN 'no_content' THEN concat('Failed to scrape content for ', d.node) END AS error,
  CASE WHEN outcome = 'stored' THEN length(n.content) END AS content_size,
  CASE WHEN outcome IN ('stored', 'no_content') THEN coalesce(l.n, 0) END AS found_links
FROM done d LEFT JOIN nodes n ON n.node = d.node
  LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY src) l ON l.src = d.node
""",
    "crawl_site_content": f"""
WITH {_levels(3, _SITE)},
done AS ({' UNION ALL '.join(f"SELECT node, route FROM done{d} WHERE outcome = 'stored'" for d in range(4))})
SELECT d.route, kind, d.node AS url, n.content AS body
FROM done d JOIN nodes n ON n.node = d.node, (VALUES ('content'), ('processed')) AS k(kind)
""",
    "route_dedup": f"""
WITH routed AS (SELECT doc_id, {route_of('url')} AS route, url FROM ({URLS}) u),
ranked AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY {_ORDER}) AS n FROM routed)
SELECT doc_id, route, url FROM ranked WHERE n = 1
""",
    "inflight_dedup": """
SELECT concat(event_type, '/', user_id) AS url, min(event_id) AS first_request, count(*) AS n_requests
FROM events GROUP BY 1
""",
    "cache_hits": f"""
WITH {_gaps('user_id')} SELECT event_id, k AS user_id, NOT opens AS hit FROM gaps
""",
    "reuse_asof": """
WITH asked AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('view', 'click')),
shots AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, max(event_id) AS id FROM events WHERE event_type = 'signup' GROUP BY ALL),
served AS (
  SELECT a.event_id, a.user_id, s.id, a.ms - s.ms AS age
  FROM asked a ASOF LEFT JOIN shots s ON a.user_id = s.user_id AND a.ms >= s.ms
)
SELECT event_id, user_id, CASE WHEN age < 48 * 3600000 THEN id END AS snapshot_id,
  CASE WHEN age < 48 * 3600000 THEN age END AS age_ms
FROM served
""",
    "cache_capacity": """
WITH last AS (
  SELECT user_id, (epoch_us(ts) // 1000) AS last_ms, event_id AS last_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events
)
SELECT user_id, last_ms, last_id FROM last WHERE n = 1 ORDER BY last_ms DESC, last_id DESC LIMIT 100
""",
    "error_rows": f"""
SELECT r.url, CASE WHEN error IS NULL THEN text ELSE '' END AS content,
  CASE WHEN error IS NULL THEN {mask('text')} ELSE '' END AS processed,
  (1700000000 + r.doc_id) * 1000 AS fetched_ms, error
FROM ({RESULTS}) r JOIN ({TEXTS}) t ON t.doc_id = r.doc_id
""",
    "report_totals": f"""
SELECT count(*) AS total, count(*) - count(error) AS successful, count(error) AS failed FROM ({RESULTS}) r
""",
    "failed_urls": f"SELECT url, error FROM ({RESULTS}) r WHERE error IS NOT NULL",
    "route_urls": f"SELECT {route_of('url')} AS route, url FROM ({RESULTS}) r",
    "route_url_lists": f"WITH {_LISTS} SELECT route, part, array_to_string(urls, ' ') AS urls FROM lists",
    "crawl_stats": f"""
SELECT round(100.0::DOUBLE * (count(*) - count(error)) / count(*), 6) AS success_rate,
  CAST(sum(content_size) AS BIGINT) AS total_size,
  round(CAST(sum(coalesce(processing_ms, 0)) AS DOUBLE) / count(*), 6) AS avg_processing_ms
FROM ({RESULTS}) r
""",
    "report_merged": f"""
SELECT count(*) AS total, count(*) - count(error) AS successful, count(error) AS failed,
  round(100.0::DOUBLE * (count(*) - count(error)) / count(*), 6) AS success_rate,
  CAST(sum(content_size) AS BIGINT) AS total_size,
  round(CAST(sum(coalesce(processing_ms, 0)) AS DOUBLE) / count(*), 6) AS avg_processing_ms,
  true AS routes_close, true AS median_close
FROM ({RESULTS}) r
""",
    "latest_version": f"""
WITH named AS (
  SELECT *, contains(name, 'flash') AND NOT contains(name, 'pro') AS wanted,
    coalesce(TRY_CAST(regexp_extract(array_to_string(regexp_extract_all(name, '\\d+\\.?\\d*'), '.'), '^\\d+(\\.\\d+)?') AS DOUBLE), 0)
      AS version
  FROM ({CATALOGUE}) c
),
best AS (
  SELECT family, replace(name, 'models/', '') AS name,
    row_number() OVER (PARTITION BY family ORDER BY version DESC, p_partkey) AS n
  FROM named WHERE wanted
)
SELECT f.family, coalesce(b.name, 'gemini-1.5-flash') AS latest
FROM (SELECT DISTINCT family FROM named) f LEFT JOIN best b ON b.family = f.family AND b.n = 1
""",
    "throttle_events": f"""
WITH {_throttle('event_type', 5, 1 / 1800)}
SELECT event_id, k AS event_type, admitted FROM run
""",
    "throttle_users": f"""
WITH {_throttle('user_id', 2, 1 / 14400)}
SELECT k AS user_id, count(*) FILTER (admitted) AS n_admitted, count(*) FILTER (NOT admitted) AS n_delayed
FROM run GROUP BY k
""",
    "throttle_stream": f"""
WITH {_throttle('event_type', 5, 1 / 1800)}
SELECT k AS key, ms, count(*) AS n_requests, count(*) FILTER (admitted) AS n_admitted
FROM run GROUP BY k, ms
""",
    "rate_audit": _HOURLY,
    "rate_audit_stream": _HOURLY,
    "rate_audit_sliding": """
SELECT event_type, (epoch_us(ts) // 1000) // 900000 * 900000 - k * 900000 AS start_ms,
  (epoch_us(ts) // 1000) // 900000 * 900000 - k * 900000 + 3600000 AS end_ms, count(*) AS n_requests
FROM events, range(4) AS r(k) GROUP BY ALL HAVING count(*) > 4
""",
    "cache_sessions": f"WITH {_gaps('user_id')} SELECT * FROM sessions",
    "session_stream": f"""
WITH {_gaps('user_id')} SELECT * FROM sessions
""",
    "retry_schedule": """
WITH failures AS (
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'HTTP 429 too many' ELSE 'timeout' END AS error,
    user_id % 5 + 1 AS attempt, (epoch_us(ts) // 1000) AS failed_ms FROM events WHERE event_type = 'error'
),
waits AS (
  SELECT *, CASE WHEN event_id % 2 = 0 THEN 'exponential' ELSE 'linear' END AS backoff,
    CASE WHEN event_id % 2 = 0 THEN (1000 * (1 << (attempt - 1)))::BIGINT ELSE 1000 * attempt END AS wait_ms
  FROM failures WHERE CASE WHEN event_id % 2 = 0 THEN attempt <= 3 ELSE attempt < 3 END
)
SELECT *, failed_ms + wait_ms AS due_ms FROM waits
""",
    "stream_dedup": f"WITH {_gaps('user_id')} SELECT k AS user_id, ms FROM gaps WHERE opens",
    "stream_ingest": f"""
WITH routed AS (SELECT page_id, {route(encoded(path('url')))} AS route, url FROM pages),
ranked AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY page_id) AS n FROM routed)
SELECT page_id, route, url FROM ranked WHERE n = 1
""",
}
