"""Checks for masks, flags, classification and prompts."""

from webcorpus.functions.stems import STEP_2, STEP_3, STEP_4

from oracles.parts import (
    BLOCKLIST,
    ENGLISH,
    LEXICON,
    MIXED,
    RESPONSES,
    RESULTS,
    RULES,
    SPACE,
    TEMPLATES,
    TEXTS,
    VERDICTS,
    domain_key,
    mask,
    path,
    route_of,
)

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def stems_of(words: str) -> str:
    """CTE stems(word, stem) of the column word: Porter's steps, each a subquery over the one before."""

    def case(table: dict[str, str], column: str = "suffix") -> str:
        return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"

    def cut(source: str, suffixes) -> str:
        pattern = f"^(.+?)({'|'.join(suffixes)})$"
        return (
            f"(SELECT word, w, regexp_extract(w, '{pattern}', 1) AS stem, regexp_extract(w, '{pattern}', 2) AS suffix FROM {source})"
        )

    def has(pattern: str, column: str = "stem") -> str:
        return f"regexp_matches({column}, '{pattern}')"

    one, two = has(f"^({_C})?{_V}{_C}"), has(f"^({_C})?{_V}{_C}{_V}{_C}")
    vowel, short = has(f"^({_C})?[aeiouy]"), has(f"^{_C}[aeiouy][^aeiouwxy]$")
    double = has("(" + "|".join(c * 2 for c in "bcdfghjkmnpqrtvwx") + ")$")
    mend = (
        f"CASE WHEN {has('(at|bl|iz)$')} THEN stem || 'e' WHEN {double} THEN left(stem, -1)"
        f" WHEN {short} THEN stem || 'e' ELSE stem END"
    )
    last = f"({two} OR ({has(f'^({_C})?{_V}{_C}({_V})?$')} AND NOT {short}))"
    return f"""
stem0 AS (SELECT word, regexp_replace(word, '^y', 'Y') AS w FROM {words} WHERE regexp_full_match(word, '[a-z]{{3,}}')),
stem1 AS (SELECT word, regexp_replace(regexp_replace(w, '^(.+?)(ss|i)es$', '\\1\\2'), '^(.+?[^s])s$', '\\1') AS w FROM stem0),
stem2 AS (
  SELECT word, CASE WHEN suffix = '' THEN w WHEN suffix = 'eed' THEN CASE WHEN {one} THEN stem || 'ee' ELSE w END
    WHEN {vowel} THEN {mend} ELSE w END AS w
  FROM {cut('stem1', ['eed', 'ed', 'ing'])}
),
stem3 AS (SELECT word, CASE WHEN suffix <> '' AND {vowel} THEN stem || 'i' ELSE w END AS w FROM {cut('stem2', ['y'])}),
stem4 AS (SELECT word, CASE WHEN suffix <> '' AND {one} THEN stem || {case(STEP_2)} ELSE w END AS w FROM {cut('stem3', STEP_2)}),
stem5 AS (SELECT word, CASE WHEN suffix <> '' AND {one} THEN stem || {case(STEP_3)} ELSE w END AS w FROM {cut('stem4', STEP_3)}),
stem6 AS (
  SELECT word, CASE WHEN suffix = '' THEN w WHEN {two} THEN stem ELSE w END AS w
  FROM (
    SELECT word, w, CASE WHEN suffix <> 'ion' OR regexp_matches(stem, '[st]$') THEN suffix ELSE '' END AS suffix, stem
    FROM {cut('stem5', [*STEP_4, 'ion'])}
  )
),
stem7 AS (SELECT word, CASE WHEN suffix <> '' AND {last} THEN stem ELSE w END AS w FROM {cut('stem6', ['e'])}),
stems AS (
  SELECT word, lower(CASE WHEN w LIKE '%ll' AND {has(f"^({_C})?{_V}{_C}{_V}{_C}", 'w')} THEN left(w, -1) ELSE w END) AS stem FROM stem7
  UNION ALL SELECT word, word FROM {words} WHERE NOT regexp_full_match(word, '[a-z]{{3,}}')
)"""


_WORDS = [
    r"\b(?:www\.)?[a-z0-9-]+\.(?:xxx|adult|porn)\b",
    r"\.onion\b",
    r"\b(?:escort|adult-massage)services?\b",
    r"\b18\+(?:explicit|only)\b",
    r"\b(?:buy|sell|trade)(?:adult)?(?:pic|video|content)\b",
    r"(?:crypto|bitcoin|payment)(?:for|to)(?:content|service)",
]
_CONTEXT = (
    r"(payment|money|crypto) +(required|needed|only)|(private|secret) +(content|message|dm)"
    r"|(adult|xxx) +(content|material)"
)
_FIRST_HITS = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, min(i) AS at FROM words WHERE regexp_matches(word, '{p}') GROUP BY doc_id"
    for k, p in enumerate(_WORDS)
)
_SUSPICIOUS = f"""
words AS (
  SELECT doc_id, i, word
  FROM texts, unnest(string_split_regex(lower(text), '{SPACE}+')) WITH ORDINALITY AS w(word, i)
),
hits AS ({_FIRST_HITS}),
contexts AS (
  SELECT h.doc_id, h.k, string_agg(w.word, ' ' ORDER BY w.i) AS around
  FROM hits h JOIN words w ON w.doc_id = h.doc_id AND w.i >= h.at - 10 AND w.i < h.at + 10
  GROUP BY h.doc_id, h.k
),
suspects AS (SELECT DISTINCT doc_id FROM contexts WHERE regexp_matches(around, '{_CONTEXT}'))
"""
_COMBOS = [
    ("private", "show", "payment"),
    ("send", "pic", "money"),
    ("buy", "content", "private"),
    ("trade", "content", "direct"),
    ("crypto", "content", "private"),
]
_COMBO = " OR ".join(
    "(" + " AND ".join(f"contains(lower(text), '{w}')" for w in words) + ")" for words in _COMBOS
)
_SCORES = f"""
tokens AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS token FROM texts),
scores AS (
  SELECT doc_id, count(*) AS n_tokens,
    CAST(sum(coalesce(polarity, CAST(0 AS DECIMAL(9, 4)))) AS DOUBLE) / count(*) AS score
  FROM tokens LEFT JOIN ({LEXICON}) l ON token = word GROUP BY doc_id
)
"""
_SENTIMENT = (
    "CASE WHEN score < -0.9 THEN 'extremely_negative_sentiment'"
    " WHEN score < -0.7 THEN 'negative_sentiment' END"
)
_BLANK = f"regexp_full_match(text, '{SPACE}*')"

_VALIDATED = f"""
texts AS ({TEXTS}),
{_SUSPICIOUS},
{_SCORES},
keyed AS (SELECT *, {domain_key('text')} AS d FROM texts),
found AS (
  SELECT k.doc_id, k.source, {_BLANK} AS blank, list_filter([
    CASE WHEN d IN (SELECT {domain_key('url')} FROM ({BLOCKLIST}) b)
      OR regexp_matches(d, '\\.(xxx|sex|adult|porn)$')
      OR regexp_matches(d, '^(porn|xxx|adult|sex)[-.]') THEN 'restricted_domain' END,
    CASE WHEN k.doc_id IN (SELECT doc_id FROM suspects) THEN 'suspicious_patterns' END,
    CASE WHEN {_COMBO} THEN 'keyword_combinations' END,
    {_SENTIMENT},
    CASE WHEN verdict = 'unsafe' THEN 'ai_safety_check' END
  ], lambda f: f IS NOT NULL) AS flags
  FROM keyed k JOIN scores s ON s.doc_id = k.doc_id
    LEFT JOIN ({VERDICTS}) v ON v.doc_id = k.doc_id
),
validated AS (
  SELECT doc_id, source, blank, CASE WHEN NOT blank AND len(flags) > 0 THEN flags END AS flags FROM found
)
"""
_REASON = {
    "restricted_domain": "Contains restricted domain",
    "suspicious_patterns": "Contains suspicious patterns",
    "keyword_combinations": "Contains suspicious keyword combinations",
    "extremely_negative_sentiment": "Contains extremely negative sentiment",
    "negative_sentiment": "Contains negative sentiment",
    "ai_safety_check": "Flagged by AI safety check",
    "validation_error": "Validation error occurred",
}


def _reasons(flags: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REASON.items())
    return (
        f"array_to_string(list_filter(list_transform({flags}, lambda f: CASE f {cases} END),"
        " lambda r: r IS NOT NULL), '; ')"
    )


def _pair(text: str, tag: str) -> str:
    """An opening tag with a closing one somewhere after it."""
    return f"regexp_matches({text}, '(?is)<{tag}(\\s[^>]*)?>.*</{tag}>')"


def _signals(text: str) -> str:
    return f"""list_filter([
    CASE WHEN {_pair(text, 'h[1-6]')} THEN 'structured' END,
    CASE WHEN {_pair(text, '(?:ul|ol)')} THEN 'list' END,
    CASE WHEN {_pair(text, 'table')} THEN 'data' END,
    CASE WHEN contains(lower({text}), 'price') OR regexp_matches({text}, '\\$\\d+') THEN 'price' END,
    CASE WHEN contains(lower({text}), 'author') OR regexp_matches({text}, '(?i)posted by') THEN 'article' END,
    CASE WHEN contains(lower({text}), 'profile') OR regexp_matches({text}, '(?i)about me') THEN 'bio' END
  ], lambda s: s IS NOT NULL)"""


_TYPED = f"""
pages_in AS (
  SELECT t.doc_id, m.url, CASE WHEN t.doc_id % 3 = 0 THEN m.html ELSE t.text END AS content
  FROM ({TEXTS}) t JOIN ({MIXED}) m ON m.page_id = t.doc_id
),
signalled AS (SELECT *, {path('url')} AS path, {_signals('content')} AS signals FROM pages_in),
typed AS (
  SELECT *, CASE
    WHEN regexp_matches(path, '/(article|blog|news|post)') OR list_contains(signals, 'article') THEN 'article'
    WHEN regexp_matches(path, '/(product|item|shop)') OR list_contains(signals, 'price') THEN 'product'
    WHEN regexp_matches(path, '/(category|department|section)') OR list_contains(signals, 'list') THEN 'category'
    WHEN regexp_matches(path, '/(profile|user|about)') OR list_contains(signals, 'bio') THEN 'profile'
    ELSE 'general' END AS page_type
  FROM signalled
)
"""
_STRUCTURE = (
    "CASE page_type WHEN 'article' THEN 'narrative' WHEN 'category' THEN 'analytical'"
    " ELSE 'descriptive' END"
)


def _processed(valid: str) -> str:
    return f"""
SELECT t.doc_id, CASE
  WHEN {_BLANK} THEN ''
  WHEN response_error LIKE '%429%' OR response_error LIKE '%quota%' THEN {mask('text')}
  WHEN response_error IS NOT NULL OR response IS NULL THEN ''
  {valid}
  ELSE {mask('text')} END AS processed
FROM ({TEXTS}) t LEFT JOIN ({RESPONSES}) r ON r.doc_id = t.doc_id
"""


SQL = {
    "credential_shapes": f"""
WITH marked AS (
  SELECT source, CASE WHEN doc_id % 3 = 0 THEN concat(text, ' AIza_-0', md5(text))
    WHEN doc_id % 3 = 1 THEN concat(text, ' AIza', md5(text)) ELSE text END AS text FROM documents
)
SELECT source, CAST(sum(len(list_filter(string_split_regex(text, '{SPACE}+'),
  lambda w: regexp_full_match(w, 'AIza[0-9A-Za-z_-]{{35}}')))) AS BIGINT) AS n_keys
FROM marked GROUP BY source
""",
    "error_class": f"""
SELECT CASE WHEN error LIKE '%429%' OR error LIKE '%quota%' THEN 'quota' ELSE 'other' END AS error_class,
  count(*) AS n FROM ({RESULTS}) r WHERE error IS NOT NULL GROUP BY 1
""",
    "filter_text": f"SELECT doc_id, {mask('text')} AS text FROM ({TEXTS}) t",
    "filter_text_all": f"SELECT doc_id, {mask('text', 'gi')} AS text FROM ({TEXTS}) t",
    "filter_text_array": f"""
SELECT doc_id, concat('  and xxx', chr(10), {mask('text')}, chr(10), ' ') AS text FROM ({TEXTS}) t
""",
    "suspicious_flag": f"""
WITH texts AS ({TEXTS}), {_SUSPICIOUS}
SELECT doc_id, doc_id IN (SELECT doc_id FROM suspects) AS suspicious FROM texts
""",
    "keyword_combo_flag": f"SELECT doc_id, {_COMBO} AS combination FROM ({TEXTS}) t",
    "rule_matches": f"""
SELECT doc_id, rule_id FROM ({TEXTS}) t JOIN ({RULES}) r
  ON concat(a, b, c) <> '' AND contains(lower(text), a) AND contains(lower(text), b) AND contains(lower(text), c)
""",
    "sentiment_score": f"""
WITH texts AS ({TEXTS}), {_SCORES}
SELECT doc_id, n_tokens, round(score, 8) AS score FROM scores
""",
    "sentiment_stemmed": f"""
WITH texts AS ({TEXTS}), lexicon AS ({ENGLISH}),
spoken AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM texts),
words AS (SELECT DISTINCT word FROM spoken UNION SELECT lower(word) FROM lexicon),
{stems_of('words')},
vocabulary AS (
  SELECT stem, max_by(polarity, lower(l.word)) AS polarity FROM lexicon l JOIN stems s ON s.word = lower(l.word) GROUP BY stem
),
known AS (
  SELECT s.word, coalesce(d.polarity, v.polarity, 0) AS polarity
  FROM stems s LEFT JOIN vocabulary d ON d.stem = s.word LEFT JOIN vocabulary v ON v.stem = s.stem
),
scores AS (
  SELECT doc_id, count(*) AS n_tokens, CAST(sum(CAST(polarity AS DECIMAL(9, 4))) AS DOUBLE) / count(*) AS score
  FROM spoken JOIN known USING (word) GROUP BY doc_id
)
SELECT doc_id, n_tokens, round(score, 8) AS score FROM scores
""",
    "sentiment_flags": f"""
WITH texts AS ({TEXTS}), {_SCORES}
SELECT doc_id, {_SENTIMENT} AS flag FROM scores
""",
    "ai_verdicts": f"""
SELECT t.doc_id, coalesce(toxic = 1 AND t.doc_id % 3 <> 0, false) AS unsafe,
  coalesce(toxic = 1, false) AS unsafe_any_case
FROM ({TEXTS}) t LEFT JOIN labels l ON l.doc_id = t.doc_id
""",
    "validate_content": f"""
WITH {_VALIDATED}
SELECT doc_id, source, NOT blank AND flags IS NULL AS is_valid,
  CASE WHEN blank THEN 'Empty content' WHEN flags IS NOT NULL THEN {_reasons('flags')} END AS reason,
  array_to_string(flags, '|') AS flags
FROM validated
""",
    "validation_counts": f"""
WITH {_VALIDATED}
SELECT source, flag, count(*) AS n FROM (SELECT source, unnest(flags) AS flag FROM validated) f
GROUP BY source, flag
""",
    "flag_reasons": f"""
SELECT doc_id, {_reasons('''[
  CASE WHEN doc_id % 2 = 0 THEN 'restricted_domain' END,
  CASE WHEN toxic = 1 AND doc_id % 3 <> 0 THEN 'ai_safety_check' END,
  CASE WHEN doc_id % 3 = 0 THEN 'unknown_flag' END,
  CASE WHEN doc_id % 5 = 0 THEN 'validation_error' END]''')} AS reasons
FROM labels
""",
    "processed_content": _processed(""),
    "processed_responses": _processed("WHEN response_valid THEN response"),
    "content_signals": f"""
WITH {_TYPED} SELECT doc_id, array_to_string(signals, '|') AS signals FROM typed
""",
    "page_signals": f"SELECT page_id, array_to_string({_signals('html')}, '|') AS signals FROM pages",
    "page_context": f"""
WITH {_TYPED}
SELECT doc_id, page_type,
  CASE page_type WHEN 'article' THEN 'detailed' WHEN 'category' THEN 'brief' ELSE 'standard' END
    AS content_length,
  {_STRUCTURE} AS structure_type, 'general' AS target_audience
FROM typed
""",
    "page_type_counts": f"WITH {_TYPED} SELECT page_type, count(*) AS n_pages FROM typed GROUP BY page_type",
    "build_prompts": f"""
WITH {_TYPED}
SELECT doc_id, replace(coalesce(template, '{{content}}'), '{{content}}', content) AS prompt
FROM (SELECT *, {_STRUCTURE} AS structure_type FROM typed) p
  LEFT JOIN ({TEMPLATES}) t USING (page_type, structure_type)
""",
    "corpus_overview": f"""
WITH {_TYPED}, keyed AS (SELECT *, {domain_key('url')} AS d, {route_of('url')} AS route FROM typed)
SELECT page_type, d IN (SELECT {domain_key('url')} FROM ({BLOCKLIST}) b)
    OR regexp_matches(d, '\\.(xxx|sex|adult|porn)$') OR regexp_matches(d, '^(porn|xxx|adult|sex)[-.]')
    AS restricted, count(*) AS n_pages, count(DISTINCT route) AS n_routes
FROM keyed GROUP BY 1, 2
""",
}
