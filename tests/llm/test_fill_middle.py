import hashlib
import re

import numpy as np
import pytest

from webcorpus.llm import fill_middle
from webcorpus.llm.fill_middle import Exceptions, op13

from .data import ODD, corpus, row, table

HARD = ["<P>", "a<S>b", "x<M>", "<", "<P", "a<b>c<", "é", "ééé😀x", "日本語 text 😀😀 ünï", "a" * 50, "<S <P <M >", "tab\tnl\n\r\n", "\x00a\x00"]


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted(x % (n + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows):
    found = sorted((tuple(r) for r in op13(table(spark, rows)).collect()), key=str)
    wanted = []
    for doc_id, text, *_ in rows:
        *facts, output = expected(doc_id, text)
        wanted.append((doc_id, *facts, sha(output), sha(text or "")))
    assert found == sorted(wanted, key=str)


def test_against_plain_python(spark):
    rows = ODD + corpus(60) + [row(100 * i + k, t) for k, t in enumerate(HARD) for i in range(12)]
    check(spark, rows)


def test_forms_all_occur_and_outputs_are_whole(spark):
    rows = corpus(200)
    made = {r.doc_id: r for r in fill_middle.fill_middle(table(spark, rows)).collect()}
    assert {r.form for r in made.values()} == {"plain", "psm", "spm"}
    for doc_id, text, *_ in rows:
        assert tuple(made[doc_id])[1:] == expected(doc_id, text)


def test_empty_table(spark):
    assert op13(table(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["", "plain", "é", "aé日😀z", "😀" * 5, "x" * 300 + "é" + "y" * 300, "日本"])
def test_positions_convert_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    index = Exceptions(data)
    at_points = np.arange(len(text) + 1)
    at_bytes = np.array([len(text[:k].encode()) for k in at_points])
    assert index.bytes(at_points).tolist() == at_bytes.tolist()
    assert index.points(at_bytes).tolist() == at_points.tolist()
    # Only characters of several bytes are recorded.
    assert len(index.at_bytes) == sum(len(c.encode()) > 1 for c in text)


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in op13(docs).collect()}
    for doc_id, text in rows:
        *facts, output = expected(doc_id, text)
        assert tuple(found[doc_id])[1:5] == tuple(facts) and found[doc_id].output_sha256 == sha(output) and found[doc_id].restored_sha256 == sha(text or "")
