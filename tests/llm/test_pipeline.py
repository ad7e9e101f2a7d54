"""The pipeline against its stages done by hand on a small table."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.data import ODD, corpus, prose, row, table
from tests.llm.test_scans import plain_scan
from tests.llm.test_simhash import brute_components, brute_fingerprint
from webcorpus.llm import language, registry


def test_the_entry_has_every_query():
    assert set(registry.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {name.split("_")[0] for name in registry.QUERIES}
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_do_what_they_say(spark, tmp_path):
    passage = prose(777, 30)
    rows = corpus(60) + ODD + [row(200 + k, corpus(60)[k][1] + " more", "en") for k in range(6)]
    rows += [row(300, f"{prose(50, 60)} {passage} {prose(51, 60)}"), row(301, f"{prose(52, 40)} token = 'abcdefabcdef0123' {prose(53, 20)}")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == columns
        seen[name] = docs.collect()

    lettered = [r for r in rows if r[1] and language.lettered(r[1])]
    assert Counter(r.doc_id for r in seen["language_id"]) == Counter(r[0] for r in lettered)
    label = brute_components([brute_fingerprint(r[1]) for r in lettered])
    low = {}
    for r, c in zip(lettered, label):
        low[c] = min(low.get(c, 10**9), r[0] if r[0] is not None else 10**9)
    assert sorted(10**9 if r.doc_id is None else r.doc_id for r in seen["near_dedup"]) == sorted(low.values())
    assert {r.doc_id for r in seen["near_dedup"]} - {r.doc_id for r in seen["decontaminate"]} == {300}
    before = {r.doc_id: r.text for r in seen["decontaminate"]}
    after = {r.doc_id: r.text for r in seen["secrets"]}
    assert set(before) == set(after)
    assert {i for i in before if before[i] != after[i]} == {301} and plain_scan(after[301])[1] == ""
    assert {r.doc_id for r in seen["mix"]} <= set(after)
    assert all(r.text == after[r.doc_id] for r in seen["mix"])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.copy, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.copy, r.shard) for r in seen["mix"])


def test_unlabelled_corpora_keep_their_texts(spark):
    rows = [(*r[:2], None, *r[3:]) for r in corpus(20) + ODD]
    unlabelled = table(spark, rows)
    letterless = unlabelled.unionAll(table(spark, [row(500, "12345 !!!", "en")]))
    expected = Counter(r[0] for r in rows if r[1] and language.lettered(r[1]))
    for docs in (unlabelled, letterless):
        found = corpus_pipeline.identify_language(spark, docs, "")
        assert found.columns == docs.columns
        assert Counter(r.doc_id for r in found.collect()) == expected
