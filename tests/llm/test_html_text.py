import itertools
import os
import re
import subprocess
import sys
import time
from html import escape, unescape

import pytest
from pyspark import cloudpickle
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.data import prose
from webcorpus.llm import html_text


def article(html):
    """The article of a page of the given tables, by its known markup."""
    inner = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    parts = re.sub(r"</?(?:p|br|h1)>", "\0", inner)
    lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts.split("\0")]
    return "\n".join(line for line in lines if line)


def test_given_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    found = html_text.op10(pages).collect()
    assert len(found) == len(html)
    for r in found:
        assert r.text == article(html[r.page_id]) and r.n_chars == len(r.text)


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.floats(-3, 3), min_size=1, max_size=9),
    st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.floats(0, 2)), max_size=16),
)
def test_cut_has_the_least_cost(odds, edges):
    edges = [(a, b, w) for a, b, w in edges if a < len(odds) and b < len(odds) and a != b]

    def cost(label):
        own = sum(abs(o) for o, x in zip(odds, label) if x != (o > 0))
        return own + sum(w for a, b, w in edges if label[a] != label[b])

    best = min(map(cost, itertools.product([False, True], repeat=len(odds))))
    assert abs(cost(html_text.least_cut(odds, edges)) - best) < 1e-9


def test_long_chain_is_cut_without_recursion():
    n = 5000
    label = html_text.least_cut([0.3 if k % 3 else -0.4 for k in range(n)], [(k, k + 1, 0.35) for k in range(n - 1)])
    assert len(label) == n and sum(label) > n / 2


FULL = """<!DOCTYPE html><html><head><title>Site</title><style>p{color:red}</style></head><body class="has-sidebar">
<header><a href="/">Site name</a><p>Slogan of the whole site.</p></header><nav><ul><li><a href=/a>News</a></li></ul></nav>
<div id="cookie-notice">We use cookies. Please accept them all.</div><main><article><header><h1>The &lt;Title&gt;</h1></header>
<p>First <i>para</i>graph &amp; more&nbsp;text,
 over lines.</p><script>var x = "<p>no</p>";</script><div class="advert">Buy our things now, they are very cheap.</div><p>Ok.</p><!-- <p>hidden</p> -->
<ul><li>one<li>two</ul><form><label>Your mail</label><input name=x><button>Send</button></form><table><tr><td>a</td><td>b</td></tr></table>
<aside>An aside with a whole sentence that is long enough.</aside><section class="comments"><h2>Comments</h2><p>A reader says that this is a good page, indeed.</p></section>
</article></main><div class="sidebar"><p>Popular posts are listed over here, come and see them.</p></div><footer>&copy; 2024 Site</footer></body></html>"""


def test_everything_but_the_article_goes():
    assert html_text.main_text(FULL) == "The <Title>\nFirst paragraph & more text, over lines.\nOk.\none\ntwo\na\nb"


def test_pages_without_telling_containers():
    paras = [prose(k, 40).capitalize() for k in range(4)] + ["Short one."]
    links = "".join(f"<a href=/{k}>{w}</a> " for k, w in enumerate("home news about contact".split()))
    page = f"<body><div>{links}</div><div>{''.join(f'<p>{p}</p>' for p in paras)}</div><div>{links}</div></body>"
    assert html_text.main_text(page) == "\n".join(paras)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<article>a<br>b</article>", "a\nb"),
        ("<article>x &#8364; &eacute; &amp;lt; &unknown;</article>", "x € é &lt; &unknown;"),
        ("<article><p>unclosed <b>bold<p>next</article>", "unclosed bold\nnext"),
        ('<article><a title="a>b" href=x>link text of an article</a> goes on here.</article>', "link text of an article goes on here."),
        ("<article>before<script>if (a<b) x()</article>", "before"),
    ],
)
def test_small_pages(html, text):
    assert html_text.main_text(html) == text


def test_rows_of_any_kind(spark):
    rows = [(1, "u", FULL, "x"), (1, "u", FULL, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", f"<article>{'<p>word</p>' * 20_000}</article>", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.op10(pages).collect()
    assert len(found) == len(rows)
    sizes = {r.page_id: r.n_chars for r in found}
    assert sizes[2] == 0 and sizes[None] == 0 and sizes[3] == 5 * 20_000 - 1
    assert html_text.op10(pages.limit(0)).collect() == []


@given(st.lists(st.text(min_size=1, max_size=30), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_escaped_text_comes_back(parts):
    html = "<article>" + "".join(f"<p>{escape(p)}</p>" for p in parts) + "</article>"
    plain = [" ".join(unescape(escape(p)).split()) for p in parts]
    assert html_text.main_text(html) == "\n".join(p for p in plain if p)


PARAS = [prose(k, 40).capitalize() for k in range(20, 24)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)
REST = '<nav><a href="/">Home</a></nav>{}<div class="sidebar"><p>Popular posts are listed over here, come and see them.</p></div><footer>Site 2024</footer>'


@pytest.mark.parametrize(
    "page",
    [
        *(f'<article class="post {name}">{BODY}</article>' for name in "category-privacy tag-legal category-social comments-open post-search post-login post-share".split()),
        f'<div class="layout right-sidebar"><article>{BODY}</article></div>',
        f'<div class="layout right-sidebar"><div>{BODY}</div></div>',
        f'<form id="aspnetForm"><main>{BODY}</main></form>',
        f'<form id="aspnetForm"><div>{BODY}</div></form>',
        f'<div class="sidebar"><div role="main">{BODY}</div></div>',
        f'<article>{BODY}<div class="related"><article class="card"><p>Another story that one may like to read.</p></article></div></article>',
        f'<main>{BODY}</main><aside><article><p>Another story that one may like to read.</p></article></aside>',
        f'<main>{BODY}<div hidden><article><p>A hidden story that nobody is to read.</p></article></div></main>',
    ],
)
def test_names_and_wrappers_do_not_drop_articles(page):
    assert html_text.main_text(f"<body>{REST.format(page)}</body>") == "\n".join(PARAS)


def test_shape_may_outweigh_a_name():
    first, last = PARAS[0], PARAS[1]
    page = f'<article><p>{first}</p><p class="teaser">{PARAS[2]}</p><p>{last}</p><p class="share">Share</p></article>'
    assert html_text.main_text(page) == "\n".join([first, PARAS[2], last])


def test_malformed_pages_take_linear_time():
    for bad in ('<b "', "<div>text ", "<a", "<!", "</script ", "<b><b></i>", "<b '\">", "<script></script ", "<div><i><div><b></i>"):
        for page in (bad * (1_000_000 // len(bad)), "<div><i><p>" + bad * (300_000 // len(bad)) + '"x>'):
            start = time.process_time()
            html_text.blocks_of(page)
            assert time.process_time() - start < 8, bad


def test_formulas_and_fallbacks_are_text():
    page = "<article><p>We see that <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds for all of these cases, always.</p><object><p>An object shows this text where it can not be shown itself.</p></object></article>"
    assert html_text.main_text(page) == "We see that x=2 holds for all of these cases, always.\nAn object shows this text where it can not be shown itself."


def test_workers_need_no_package(tmp_path):
    """What is sent to a worker works in a folder where the package can not be imported."""
    sent = tmp_path / "sent"
    sent.write_bytes(cloudpickle.dumps(html_text.main_text))
    code = "import pickle, sys; print(pickle.load(open(sys.argv[1], 'rb'))('<article><p class=x>Some text of an article that is long enough.</p></article>')); assert not any(m.startswith('webcorpus') for m in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(sent)], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == "Some text of an article that is long enough.", done.stderr
