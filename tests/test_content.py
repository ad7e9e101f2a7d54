from html.parser import HTMLParser

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webcorpus.functions.text import clean_text, heading_line, mask_phrases
from webcorpus.operators import chunks, extract
from webcorpus.operators import markup
from webcorpus.operators.markup import walk


def texts(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


def test_results_of_a_large_batch_are_sent_back_in_pieces(spark):
    seen = []

    def of(html):
        seen.append(html)
        return [html]

    batch = pa.array([str(i) for i in range(2000)] + [None])
    pieces = markup.page_by_page(iter([batch, batch[:0], batch[:3]]), of, pa.list_(pa.string()))
    assert len(next(pieces)) == len(seen) == markup.PAGES_AT_ONCE < 1000
    assert sum(map(len, pieces)) + markup.PAGES_AT_ONCE == 2004 == len(seen)
    pages = spark.range(1500).coalesce(1).select(F.col("id").alias("page_id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("<p>t"), "id", F.lit("</p><pre>c</pre>"))).alias("html"))
    found = extract.text_blocks(pages).collect()
    assert sorted((r.page_id, r.text) for r in found) == [(i, f"t{i}") for i in range(1500) if i % 5]
    assert extract.code_blocks(pages).count() == 1200


def page(spark, html):
    return spark.createDataFrame([(1, "https://a.org/", html)], "page_id long, url string, html string")


def test_clean_text(spark):
    nbsp = chr(160)
    values = ["é hi", f"  a{nbsp}b \n\t c  ", "x😀y", " 　 ", None]
    assert texts(spark, values, clean_text(F.col("t"))) == [" hi", "ab c", "xy", "", None]


def test_only_the_first_phrase_is_masked(spark):
    values = ["a xxx b xxx c", "éxxx", "xxxy", "18+ONLY 18+ only", "cam  girl escortservice", "p0rn PORN"]
    assert texts(spark, values, mask_phrases(F.col("t"))) == [
        "a   b xxx c", "é ", "xxxy", "  18+ only", "  escortservice", "  PORN",
    ]
    assert texts(spark, ["a xxx b xxx c"], mask_phrases(F.col("t"), False)) == ["a   b   c"]


def test_masking_can_join_a_phrase(spark):
    assert texts(spark, ["escort xxx service"], mask_phrases(F.col("t"))) == [" "]


def test_long_lines_are_no_problem(spark):
    long = "A" + "b " * 500_000
    assert texts(spark, [long, "Ab", "Abc", "abc", "A-c"], heading_line(F.col("t"))) == [
        True, False, True, False, False,
    ]
    assert texts(spark, ["x" * 10**6 + " xxx"], F.length(mask_phrases(F.col("t")))) == [10**6 + 2]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.sampled_from("xpo rn18+only camgirl"), max_size=30), min_size=20, max_size=40))
def test_masking_never_lengthens(spark, values):
    masked = texts(spark, values, mask_phrases(F.col("t")))
    assert all(len(m) <= len(v) for m, v in zip(masked, values))


def test_blocks_follow_nesting(spark):
    html = (
        "<body><div>a<p>b<p>c<script>var s</script><div>d <b>e</div></div>"
        "<ul><li>f<li>g<ul><li>h</ul></ul><pre>i<span>j</span></pre>"
        "<div class='CodeBox'>k</div><code><p>l</p></code><span> </span><h7>m</h7><H2>n&eacute;o</H2>"
    )
    rows = extract.text_blocks(page(spark, html)).orderBy("pos").collect()
    assert [(r.tag, r.text) for r in rows] == [
        ("div", "abcvar sd e"), ("p", "b"), ("p", "cvar s"), ("div", "d e"),
        ("li", "f"), ("li", "gh"), ("li", "h"), ("h2", "no"),
    ]
    codes = extract.code_blocks(page(spark, html)).orderBy("pos").collect()
    assert [(c.language, c.code) for c in codes] == [
        ("plaintext", "ij"), ("plaintext", "k"), ("plaintext", "l"),
    ]


def test_code_language_and_line_numbers(spark):
    html = (
        "<pre class='language-JavaScript line-numbers'>x<code>y</code></pre>"
        "<div class=highlight-css>z</div><code class='java Line-Numbers'> </code>"
    )
    rows = extract.code_blocks(page(spark, html)).orderBy("pos").collect()
    assert [(r.language, r.code, r.line_numbers) for r in rows] == [
        ("javascript", "xy", True), ("plaintext", "y", False), ("css", "z", False),
    ]


def test_primary_content_is_the_first_distinct_block(spark):
    html = "<p> </p><p>xxx a</p><p>xxx a</p><p>b</p>"
    row = extract.primary_content(page(spark, html)).first()
    assert (row.content, row.error) == ("  a", None)
    assert [r.text for r in extract.dedup_blocks(page(spark, html)).orderBy("pos").collect()] == [
        "  a", "b",
    ]
    empty = extract.primary_content(page(spark, "<table></table>")).first()
    assert (empty.content, empty.error) == (None, "Failed to scrape content for https://a.org/")


def test_records(spark):
    html = (
        "<article id=x><h1>T1</h1><div class='content big'>C1</div>"
        "<time datetime='2024'>now</time></article>"
        "<div class=out><article><h1>T2</h1></article></div>"
    )
    fields = [
        {"name": "title", "selector": "h1"},
        {"name": "content", "selector": "div.content"},
        {"name": "date", "selector": "time", "attribute": "dateTime"},
    ]
    rows = extract.page_records(page(spark, html), "article", fields).orderBy("pos").collect()
    assert [tuple(r)[2:] for r in rows] == [("T1", "C1", "2024"), ("T2", None, None)]
    inner = extract.page_records(page(spark, html), ".out article", fields[:1]).collect()
    assert [r.title for r in inner] == ["T2"]
    with pytest.raises(ValueError):
        extract.page_records(page(spark, html), "a > b", fields)


class Plain(HTMLParser):
    """Text of well-formed markup, as an independent check."""

    def __init__(self):
        super().__init__()
        self.open, self.texts = [], []

    def handle_starttag(self, tag, attrs):
        self.texts.append([tag, ""])
        self.open.append(len(self.texts) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for i in self.open:
            self.texts[i][1] += data


nodes = st.recursive(
    st.text(st.sampled_from("ab &;"), max_size=4).map(lambda t: t.replace("&", "&amp;")),
    lambda inner: st.tuples(
        st.sampled_from(["div", "span", "b"]), st.lists(inner, max_size=3)
    ).map(lambda n: f"<{n[0]}>{''.join(n[1])}</{n[0]}>"),
    max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(nodes)
def test_walk_agrees_with_a_parser_on_wellformed_markup(html):
    expected = Plain()
    expected.feed(html)
    expected.close()
    elements, pieces = walk(html)
    assert [[e.tag, "".join(pieces[e.start : e.end])] for e in elements] == expected.texts


def test_topic_chunks(spark):
    docs = spark.createDataFrame(
        [(1, "intro\nmore\n \n\nHeading One\nbody.\n"), (2, "  "), (3, "Only Heading")],
        "doc_id int, text string",
    )
    rows = chunks.topic_chunks(docs, "doc_id", "text").orderBy("doc_id", "chunk").collect()
    assert [(r.doc_id, r.text) for r in rows] == [
        (1, "intro\nmore"), (1, "Heading One\nbody."), (3, "Only Heading"),
    ]


def brute_chunks(text, overlap, limit):
    import re

    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    out, filled, before = [], 0, None
    for s in sentences:
        tokens = set(s.strip().lower().split(" "))
        apart = before is None or len(tokens & before) < overlap * len(tokens | before)
        if apart or filled + len(s) > limit:
            out.append([s])
            filled = len(s)
        else:
            out[-1].append(s)
            filled += len(s)
        before = tokens
    return [" ".join(c) for c in out]


def test_semantic_chunks_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for overlap, limit in ((0.0, 300), (0.08, 10_000), (0.05, 600)):
        rows = chunks.semantic_chunks(docs, "doc_id", "text", overlap, limit).collect()
        got: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r.doc_id, r.chunk)):
            got.setdefault(r.doc_id, []).append(r.text)
        for d in docs.collect():
            assert got.get(d.doc_id, []) == brute_chunks(d.text, overlap, limit)
