"""The crawl job from end to end, and its command line."""

import json

import pytest

from webcorpus.__main__ import main
from webcorpus.operators import joins
from webcorpus.plans import pipeline

PAGES = "page_id bigint, url string, html string"


def test_help(capsys):
    with pytest.raises(SystemExit) as stop:
        main(["--help"])
    assert stop.value.code == 0
    assert "Usage:" in capsys.readouterr().out


def test_missing_option(capsys):
    with pytest.raises(SystemExit) as stop:
        main(["--url", "https://a.org"])
    assert stop.value.code == 2
    assert "required option" in capsys.readouterr().err


def test_unknown_format(capsys):
    with pytest.raises(SystemExit):
        main(["--url", "https://a.org", "--pages", "x", "--format", "xml"])


def test_invalid_url(spark, sf, capsys):
    assert main(["--url", "invalid-url", "--pages", f"{sf}/pages.parquet"]) == 1
    assert "Invalid URL" in capsys.readouterr().err


@pytest.fixture
def site(spark):
    return spark.createDataFrame(
        [
            (1, "http://s.org", "<div>Home xxx <a href='/a'>A</a><a href='/b.html'>B</a><a href='/gone'>G</a></div>"),
            (2, "https://www.s.org/a", "<p>Page A</p><a href='/c'>C</a><a href='http://t.org/'>T</a>"),
            (3, "https://www.s.org/a/", "<p>Copy of A</p><a href='/never'>N</a>"),
            (4, "https://www.s.org/b.html", "<table></table><a href='/d'></a>"),
            (5, "https://www.s.org/b", "<p>Page B</p><a href='/e'>E</a>"),
            (6, "https://www.s.org/c", "<p>Page C</p><a href='/b'>B</a>"),
            (7, "https://www.s.org/d", "<p>Page D</p>"),
        ],
        PAGES,
    )


EXPECTED = {
    "https://www.s.org": (0, "stored", None, 10, 3),
    "https://www.s.org/a": (1, "stored", None, 6, 1),
    "https://www.s.org/b.html": (1, "no_content", "Failed to scrape content for https://www.s.org/b.html", None, 1),
    "https://www.s.org/gone": (1, "missing", pipeline.MISSING, None, None),
    "https://www.s.org/c": (2, "stored", None, 6, 1),
    "https://www.s.org/d": (2, "stored", None, 6, 0),
    "https://www.s.org/b": (3, "stored", None, 6, 1),
}


def rows(found):
    return {
        r.url: (r.depth, r.outcome, r.error, r.content_size, r.found_links)
        for r in found.results.collect()
    }


def test_crawl(spark, site):
    seeds = spark.createDataFrame([("http://www.s.org/",), ("nonsense",)], "url string")
    found = pipeline.crawl_corpus(site, seeds, first_block=True)
    got = rows(found)
    content = {(r.route, r.kind): r.body for r in found.content.collect()}
    assert content["root", "content"] == content["root", "processed"] == "Home   ABG"
    assert got == EXPECTED
    shallow = rows(pipeline.crawl_corpus(site, seeds, 1, first_block=True))
    assert shallow == {u: v for u, v in got.items() if v[0] <= 1}


def test_all_blocks_are_kept_and_masked(spark, site):
    more = spark.createDataFrame(
        [(9, "https://s.org/", "<p>xxx one xxx</p><p>two</p><p>two</p><div>xxx</div>"), (8, "https://other.org/", "<p>x</p>")], PAGES
    )
    seeds = spark.createDataFrame([("https://s.org/",)], "url string")
    found = pipeline.crawl_corpus(more, seeds)
    assert {r.body for r in found.content.collect()} == {"  one  \ntwo\n "}
    once = pipeline.crawl_corpus(more, seeds, first_block=True, first_only=True)
    assert {r.body for r in once.content.collect()} == {"  one xxx"}


def test_crawl_without_broadcasts(spark, site, monkeypatch):
    seeds = spark.createDataFrame([("http://www.s.org/",)], "url string")
    usual = rows(pipeline.crawl_corpus(site, seeds))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 2)
    assert rows(pipeline.crawl_corpus(site, seeds)) == usual


def test_policies_in_a_crawl(spark, site):
    seeds = spark.createDataFrame([("http://www.s.org/",)], "url string")
    blocklist = spark.createDataFrame([("s.org",)], "domain string")
    found = pipeline.crawl_corpus(site, seeds, blocklist=blocklist)
    got = rows(found)
    assert {v[2] for v in got.values()} == {"Domain contains restricted content", pipeline.MISSING}
    assert found.content.isEmpty()
    answers = spark.createDataFrame(
        [(1, "fine", None, True), (2, None, "429", None), (6, None, "closed", None)],
        "page_id bigint, response string, response_error string, response_valid boolean",
    )
    stored = spark.createDataFrame([("d", "content"), ("a", "processed")], "route string, kind string")
    found = pipeline.crawl_corpus(site, seeds, responses=answers, stored=stored)
    kinds = {(r.route, r.kind): r.body for r in found.content.collect()}
    assert kinds["root", "processed"] == "Home   ABG\nA\nB\nG"
    assert ("c", "content") in kinds and ("c", "processed") not in kinds
    assert ("a", "content") in kinds and ("a", "processed") not in kinds
    assert rows(found)["https://www.s.org/d"][1] == "reused"


@pytest.mark.parametrize("fmt", ["json", "csv", "markdown"])
def test_job_leaves_its_files(spark, site, tmp_path, fmt, capsys):
    pages, out = str(tmp_path / "pages"), str(tmp_path / "out")
    site.write.json(pages)
    arguments = ["-p", pages, "--input-format", "json", "-u", "http://www.s.org/", "-o", out, "-f", fmt]
    assert main(arguments) == 0
    assert "Success rate: 71.43%" in capsys.readouterr().out
    lines = [r.value for r in spark.read.text(f"{out}/results").collect()]
    assert sum("s.org" in line for line in lines) == len(EXPECTED)
    totals = spark.read.text(f"{out}/report").filter("section = 'totals'").first().value
    assert json.loads(totals) == {"total": 7, "successful": 5, "failed": 2}
    assert spark.read.parquet(f"{out}/store").count() == 10
    # A second run finds everything stored and adds nothing.
    before = sorted(map(str, spark.read.parquet(f"{out}/store").collect()))
    assert main(arguments) == 0
    assert sorted(map(str, spark.read.parquet(f"{out}/store").collect())) == before
