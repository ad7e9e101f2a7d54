"""Inputs derived from the given tables.

The raw corpora hardly contain what the policy and classification jobs look for, so their
inputs are the whole tables with URLs, phrases and markup added by id. Each definition is SQL
that means the same in Spark and in the SQL used to check the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webcorpus.sources.readers import read_requests

# One URL per document: 13 hosts, 4 top-level domains, 5 sections, 8 endings.
_URL = """concat(
    CASE WHEN doc_id % 7 = 3 THEN 'http://' ELSE 'https://' END,
    CASE WHEN doc_id % 2 = 0 THEN 'www.' ELSE '' END,
    'h', doc_id % 13, '.example.',
    CASE doc_id % 4 WHEN 0 THEN 'com' WHEN 1 THEN 'xxx' WHEN 2 THEN 'org' ELSE 'net' END,
    '/',
    CASE doc_id % 5 WHEN 0 THEN 'blog' WHEN 1 THEN 'shop' WHEN 2 THEN 'category'
      WHEN 3 THEN 'about' ELSE 'docs' END,
    '/', doc_id % 23,
    CASE CAST(floor(doc_id / 7) AS BIGINT) % 8 WHEN 0 THEN '' WHEN 1 THEN '/'
      WHEN 2 THEN '.html' WHEN 3 THEN '?a=1' WHEN 4 THEN '#top' WHEN 5 THEN '.pdf'
      WHEN 6 THEN '.JPG' ELSE '.php' END
  )"""
URLS = f"""
SELECT doc_id, source, n_chars,
  {_URL} AS url
FROM {{documents}}
"""

# The same URLs, some of them no longer valid ones.
RAW_URLS = f"""
SELECT doc_id,
  CASE doc_id % 9
    WHEN 0 THEN url
    WHEN 1 THEN replace(url, '://', ' ://')
    WHEN 2 THEN replace(url, 'example', 'exa mple')
    WHEN 3 THEN concat('mailto:', doc_id, '@example.org')
    WHEN 4 THEN replace(url, 'https://', '')
    WHEN 5 THEN concat(' ', url, ' ')
    WHEN 6 THEN 'https://'
    WHEN 7 THEN concat('https://h', doc_id, '.example.org:', 65000 + doc_id % 1000, '/x')
    ELSE upper(url) END AS url
FROM ({URLS}) u
"""

# Document texts with one phrase each that some policy looks for, and rows of edge cases.
_TEXT = """CASE doc_id % 16
    WHEN 1 THEN concat(text, ' the PRICE is low')
    WHEN 2 THEN concat(text, ' only $5 today')
    WHEN 3 THEN concat(text, ' Posted By Anna')
    WHEN 4 THEN concat(text, ' read About Me here')
    WHEN 5 THEN concat('18+ only and 18+only ', text)
    WHEN 6 THEN concat(text, ' Private show after payment')
    WHEN 7 THEN concat(text, ' go to market.onion for private  content today')
    WHEN 8 THEN concat(text, ' go to market.onion for the weather')
    WHEN 10 THEN concat('   ', text, ' caf', chr(233), chr(160), 'bar', chr(10), ' end', chr(233))
    WHEN 11 THEN concat('awful  ', text)
    WHEN 12 THEN concat('xxx a XXX b p0rn c pornography escort service, cam girl ', text)
    WHEN 13 THEN concat('xxx.shop/', text)
    WHEN 14 THEN concat('https://www.casino-win.example.org/', text)
    WHEN 15 THEN concat(text, ' a camshow and adult-massageservice near adult material')
    ELSE text END"""
TEXTS = f"""
SELECT doc_id, source,
  {_TEXT} AS text
FROM {{documents}}
UNION ALL
SELECT CAST(id AS BIGINT), 'edge', text FROM (VALUES (-1, '   '), (-2, ''),
  (-3, 'worst worst awful worst worst'), (-4, 'awful worst bad awful'), (-5, 'xxx')) AS e(id, text)
"""

# Pages around the document texts: headings, lists, tables, code and many kinds of links.
_HTML = """concat(
    '<html><body><div class="main"><h2>Item ', d.doc_id, ' &amp; more</h2>',
    '<a href="/docs/', d.doc_id % 17, '/">in</a>',
    '<a href="../up/./', d.doc_id % 11, '.html#sec">up</a>',
    '<a class="m" href=''mailto:x@example.org''>mail</a><a href="JavaScript:void(0)">run</a>',
    '<a href="http://www.h', d.doc_id % 13, '.example.org/b?x=1&amp;y=', d.doc_id, '">out</a>',
    '<a href="/files/', d.doc_id, '.PDF">file</a>',
    '<a title="a>b" href="/gt/', d.doc_id % 19, '">gt</a>',
    '<a id=r href=/x?a=1&#038;b=caf&eacute;>ref</a><!-- <a href="/gone">gone</a> -->',
    CASE d.doc_id % 5
      WHEN 0 THEN '<ul><li>one</li><li>two</li></ul>'
      WHEN 1 THEN '<table><tr><td>cell</td></tr></table>'
      WHEN 2 THEN '<pre class="language-javascript line-numbers">let a = 1;</pre>'
      WHEN 3 THEN '<div class="highlight Python">print(1) </div>'
      ELSE '<p>see <code>x</code></p>' END,
    '</div><p>', replace(replace(d.text, '&', '&amp;'), '<', '&lt;'), '</p></body></html>'
  )"""
PAGES = f"""
SELECT d.doc_id AS page_id, u.url,
  {_HTML} AS html
FROM {{documents}} d JOIN ({URLS}) u ON d.doc_id = u.doc_id
"""

# Every document with its URL, text and page, in one reading of the documents.
ADDRESSED = f"""
SELECT doc_id, source, url, {_TEXT} AS text, {_HTML} AS html
FROM (SELECT *, {_URL} AS url FROM {{documents}}) d
"""

# One crawl result per document.
RESULTS = f"""
SELECT doc_id, url,
  CASE WHEN doc_id % 10 = 0 THEN '429 quota' WHEN doc_id % 10 = 1 THEN 'timeout' END AS error,
  n_chars AS content_size, doc_id % 7 AS found_links,
  CASE WHEN doc_id % 6 <> 0 THEN doc_id % 900 END AS processing_ms
FROM ({URLS}) u
"""

# Three links per page, to other pages.
EDGES = " UNION ALL ".join(
    f"SELECT page_id AS src, (page_id * {k + 1} + {k}) % (SELECT count(*) FROM {{pages}}) AS dst"
    " FROM {pages}"
    for k in (1, 2, 3)
)

# One site with the given pages' markup: neighbours share a storage route, and each page links to
# three others. Some pages carry a restricted phrase in their first block; some more pages are void.
def _site_path(page: str) -> str:
    return (
        f"concat('/', CASE (({page}) - ({page}) % 2) % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'shop'"
        f" ELSE 'docs' END, '/', ({page}) - ({page}) % 2,"
        f" CASE WHEN ({page}) % 2 = 1 THEN '.html' ELSE '' END)"
    )


_ANCHORS = ", ".join(
    "'<a href=\"', " + _site_path(f"(page_id * {k + 1} + {k}) % n") + ", '\">x</a>'"
    for k in (1, 2, 3)
)
SITE = f"""
SELECT page_id, concat('http://corpus.example', {_site_path("page_id")}) AS url,
  concat('<div>Page ', page_id, CASE WHEN page_id % 7 = 0 THEN ' xxx' ELSE '' END, '</div>',
    {_ANCHORS}, '<a href="/nowhere/', page_id % 5, '">gone</a>',
    '<a href="/void/', page_id - page_id % 13 + 5, '">void</a>', html) AS html
FROM (SELECT *, (SELECT count(*) FROM {{pages}}) AS n FROM {{pages}}) p
UNION ALL
SELECT -1 - page_id, concat('http://corpus.example/void/', page_id), '<p></p>'
FROM {{pages}} WHERE page_id % 13 = 5
"""

# Routes stored by an earlier run: those of the labelled documents.
PRIOR = f"""
SELECT u.doc_id, u.url FROM ({URLS}) u JOIN {{labels}} l ON u.doc_id = l.doc_id
"""

# Listed sites: the trap hosts that occur in the crawl.
BLOCKLIST = """
SELECT DISTINCT url FROM {pages}
WHERE url LIKE '%adult-x.%' OR url LIKE '%casino-win.%' OR url LIKE '%spam-farm.%'
  OR url LIKE '%cheap-pills.%'
"""

# Word polarities; a small input table beside the corpus.
LEXICON = """
SELECT word, CAST(polarity AS DECIMAL(9, 4)) AS polarity
FROM (VALUES ('worst', -1.0), ('awful', -0.8), ('bad', -0.6), ('good', 0.7), ('best', 1.0),
  ('was', -0.1), ('with', 0.1), ('than', -0.2), ('est', -0.1), ('sur', 0.15), ('der', 0.05),
  ('nicht', -0.4), ('para', 0.1), ('los', -0.05)) AS t(word, polarity)
"""

# Polarities of English words, some of which share a stem with each other or with words of the texts.
ENGLISH = """
SELECT word, CAST(polarity AS DECIMAL(9, 4)) AS polarity
FROM (VALUES ('worst', -1.0), ('awful', -0.8), ('private', -0.2), ('needed', 0.2), ('markets', 0.1),
  ('weathered', -0.3), ('end', 0.05), ('ended', -0.05), ('prices', -0.1), ('paying', 0.3), ('shows', 0.15),
  ('onions', 0.02), ('things', 0.01), ('services', 0.4), ('adults', -0.5), ('reading', 0.6), ('thing', 0.03),
  ('ationing', 0.07), ('ering', -0.07), ('ented', 0.11), ('ons', 0.13), ('les', -0.11)) AS t(word, polarity)
"""

# A rule per labelled document, of three of its words; and the fixed combinations are rules of their own.
RULES = """
SELECT l.doc_id AS rule_id, split_part(lower(text), ' ', 2) AS a, split_part(lower(text), ' ', 4) AS b,
  split_part(lower(text), ' ', 7) AS c
FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id
"""

# A model's verdict per labelled document.
VERDICTS = """
SELECT doc_id, CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN 'UNSAFE' WHEN toxic = 1 THEN 'unsafe'
  ELSE 'SAFE' END AS verdict FROM {labels}
"""

# Prompt templates by page type and structure; other pages get the default.
TEMPLATES = """
SELECT page_type, structure_type, template FROM (VALUES
  ('article', 'narrative', 'Article: {content} (end)'),
  ('product', 'descriptive', 'Product. {content}'),
  ('profile', 'narrative', 'unused'),
  ('profile', 'descriptive', 'A profile without its text'))
  AS t(page_type, structure_type, template)
"""

# A model's response per document; some calls failed, some are missing.
RESPONSES = """
SELECT doc_id,
  CASE WHEN doc_id % 5 > 1 THEN concat('summary of ', source) END AS response,
  CASE WHEN doc_id % 5 = 0 THEN 'quota exceeded' WHEN doc_id % 35 = 1 THEN 'socket closed' END
    AS response_error,
  doc_id % 3 <> 0 AS response_valid
FROM {documents} WHERE source <> 'src3'
"""

# Versioned names per family, from the parts catalogue.
CATALOGUE = """
SELECT p_partkey, p_brand AS family,
  concat('models/', replace(p_name, ' ', '-'), '-', p_size % 4,
    CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('.', p_size % 10) END,
    CASE WHEN p_brand = 'Brand#7' THEN '-lite' WHEN p_partkey % 4 = 0 THEN '-flash'
      WHEN p_partkey % 4 = 1 THEN '-flash-pro' WHEN p_partkey % 4 = 2 THEN '-lite'
      ELSE '-flash-001' END) AS name
FROM {part}
"""

# Embeddings with a close copy of each and one at a cosine between 0.91 and 0.99.
VECTORS = """
SELECT vec_id * 3 AS vec_id, vec_id AS origin, 0.0 AS shift, embedding FROM {embeddings}
UNION ALL
SELECT vec_id * 3 + 1, vec_id, 0.002, embedding FROM {embeddings}
UNION ALL
SELECT vec_id * 3 + 2, vec_id, 0.014 + 0.002 * (vec_id % 12), embedding FROM {embeddings}
"""


# Tables whose rows cost much work each.
WIDE = ("documents", "pages", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. On a cluster it is read as it lies, without any shuffle.

    In one local process, where a small file is a single row group that Spark cannot split, wide
    rows are spread over the threads.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    context = spark.sparkContext
    if name in WIDE and context.master.startswith("local["):
        return df.repartition(context.defaultParallelism)
    return df


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run a definition over the tables it names in braces."""
    names = [n for n in ("documents", "pages", "labels", "part", "embeddings") if f"{{{n}}}" in sql]
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names}) if names else spark.sql(sql)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RULES as (rule_id, keywords): the words are cut out of the texts first, so that no text is moved."""
    start = F.lower(F.substring_index("text", " ", 7))
    words = F.array(*(F.split_part(start, F.lit(" "), F.lit(k)) for k in (2, 4, 7)))
    starts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", words.alias("keywords"))
    return table(spark, sf_dir, "labels").join(starts, "doc_id").select(F.col("doc_id").alias("rule_id"), "keywords")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as requests."""
    return read_requests(spark, f"{sf_dir}/events.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings and their shifted copies as (vec_id, embedding)."""
    rows = derive(spark, sf_dir, VECTORS)
    moved = F.transform(
        "embedding",
        lambda x, i: x.cast("double")
        + F.col("shift").cast("double") * ((F.col("origin") + i) % 5 - 2).cast("double"),
    )
    return rows.select("vec_id", moved.alias("embedding"))
