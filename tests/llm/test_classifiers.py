"""Language identification and quality scores: held-out accuracy and the odd cases."""

import unicodedata

import numpy as np

from tests.llm.data import ODD, corpus, prose, remainder, row, table
from webcorpus.llm import language, quality


def test_held_out_languages(spark):
    rows = corpus(240)
    found = language.op8(table(spark, rows + ODD)).collect()
    assert len(found) == len(rows) + len(ODD)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in found if r.doc_id in truth and r.held_out]
    assert len(held) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    for r in found:
        assert 0 <= r.score <= 1
        assert r.held_out == (remainder(r.doc_id, 4) == 2)
    none = {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (9001, 9002, 9003, 9004)}
    assert none == dict.fromkeys((9001, 9002, 9003, 9004), ("und", 0.0))


def test_predictions_ignore_language_source_and_id(spark):
    rows = corpus(120)
    model = language.fit(table(spark, rows).select("doc_id", "text", "lang"))
    again = language.fit(table(spark, rows[::-1]).select("doc_id", "text", "lang"))
    for text in (prose(1, 30, "de"), prose(2, 5, "es"), "x"):
        assert model.predict(text) == again.predict(text)


def test_families_come_first(spark):
    model = language.fit(table(spark, corpus(160)).select("doc_id", "text", "lang"))
    assert {f: sorted(own) for f, own in model.languages.items()} == {"germanic": ["de", "en"], "romance": ["es", "fr"]}
    assert set(model.machines) == {("germanic", "romance"), ("de", "en"), ("es", "fr")}
    assert language.family_of("xx") == "=xx"


def test_few_or_no_languages(spark):
    empty = table(spark, [])
    assert language.op8(empty).collect() == [] and language.keep_identified(empty).collect() == []
    alone = language.op8(table(spark, [row(i, prose(i, 10)) for i in range(30)])).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("en", 1.0)}
    unknown = language.op8(table(spark, [row(i, "some text", None) for i in range(5)])).collect()
    assert {r.lang_pred for r in unknown} == {"und"}


def test_letters_are_category_l():
    for c in map(chr, [*range(0x3000), 0x1D7D8, 0x1F100, 0x20000, 0x10330]):
        assert language.lettered(f"1 {c} _") == unicodedata.category(c).startswith("L")


def test_query_against_a_plain_vote(spark):
    """Predictions anew from the machines: every pair of families votes, then every pair of the family's languages."""
    rows = corpus(160) + ODD + [row(9100, "\u00bd \u00b2"), row(9101, "\u2167 2")]
    docs = table(spark, rows)
    found = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language.op8(docs).collect())
    model = language.fit(docs.filter("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <> 2").select("doc_id", "text", "lang"))
    families = {}
    for name in sorted({r[2] for r in rows if r[2] and r[1] and remainder(r[0], 4) != 2 and any(c.isalpha() for c in r[1])} - {None}):
        families.setdefault(language.family_of(name), []).append(name)

    def vote(sides, x):
        means = []
        for a in sides:
            chances = []
            for b in sides:
                if a != b:
                    w, bias, slope = model.machines[min(a, b), max(a, b)]
                    p = 1 / (1 + np.exp(-slope * (np.dot(x, w) + bias)))
                    chances.append(p if a < b else 1 - p)
            means.append(np.mean(chances) if chances else 1.0)
        k = int(np.argmax(means))
        return sides[k], means[k]

    expected = []
    for doc_id, text, *_ in rows:
        if not text or not any(unicodedata.category(c).startswith("L") for c in text):
            expected.append((str(doc_id), "und", 0.0))
            continue
        x = language.features(text)
        family, first = vote(sorted(families), x)
        name, second = vote(sorted(families[family]), x)
        expected.append((str(doc_id), name, round(float(first * second), 9)))
    assert found == sorted(expected)


def test_the_stage_keeps_all_with_a_letter(spark):
    rows = corpus(80) + ODD
    kept = language.keep_identified(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    expected = [str(r[0]) for r in rows if r[1] and language.lettered(r[1])]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(expected)


def junk(seed):
    rng = np.random.default_rng(seed)
    word = prose(seed, 1).rstrip(".")
    return [f"{word} " * 60, " ".join(f"{w}###$$" for w in prose(seed, 40).split()), " | ".join(prose(seed, 50).split())][rng.integers(3)]


def test_held_out_quality(spark):
    rows = [row(i, junk(i) if i % 4 == 0 else prose(i, 40 + i % 30)) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(600)] + [(5, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.op1(table(spark, rows + ODD), labels).collect()
    assert len(found) == len(rows) + len(ODD)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 > 0) for r in held]) > 0.95
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (remainder(r.doc_id, 3) == 1)


def test_compiled_rules_equal_rules_in_python(spark):
    rows = [row(i, prose(i, 5 + i)) for i in range(40)] + [row(99, "")]
    rules = [((("log_words", True, 3.0),), 1.5), ((("log_words", False, 3.0), ("word_bytes", True, 4.5)), -2.0)]
    ensemble = quality.RuleEnsemble(0.25, [(quality._tidy(r), w) for r, w in rules])
    table_ = quality.measured(table(spark, rows).select("doc_id", "text"))
    for r in table_.withColumn("p", ensemble.score()).collect():
        total = 0.25
        for rule, weight in rules:
            total += weight * all((r[n] <= t) == at_most for n, at_most, t in rule)
        assert abs(r.p - 1 / (1 + np.exp(-total))) < 1e-12


def test_labels_of_one_kind_or_none(spark):
    docs = table(spark, corpus(20))
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality.op1(docs, none).collect()} == {0.5}
    good = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    assert all(r.score > 0.8 for r in quality.op1(docs, good).collect())
    assert quality.op1(table(spark, []), good).collect() == []
