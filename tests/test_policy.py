import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from webcorpus.functions.stems import porter_stem
from webcorpus.operators import classify, policy, rules
from webcorpus.plans import derived


def texts(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


@pytest.fixture(scope="module")
def blocklist(spark):
    entries = spark.createDataFrame([("https://www.Bad.org/x",), ("bad.org",), ("evil.com:80",)], "d string")
    listed = policy.load_blocklist(entries, "d")
    assert {r.domain for r in listed.collect()} == {"bad.org", "evil.com:80"}
    return listed


def test_restricted(spark, blocklist):
    cases = {
        "http://bad.org/a/b": True,
        "http://sub.bad.org": False,
        "evil.com": False,
        "HTTP://EVIL.com:80/": True,
        "https://x.xxx": True,
        "https://x.xxx:80": False,
        "https://x.xxx\n": False,
        "xxx.a/rest": True,
        "sex-ed.org": True,
        "sexed.org": False,
        "m.adult-x.org": False,
        "bad.org " + "y" * 300: False,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    rows = policy.flag_restricted(df, "t", blocklist, "i").orderBy("i").collect()
    assert [r.restricted for r in rows] == list(cases.values())
    assert [tuple(r)[:2] for r in rows] == list(enumerate(cases))


def test_redirect_error(spark, blocklist):
    visits = spark.createDataFrame(
        [(1, "http://a.org", "http://bad.org"), (2, "http://a.org", "http://b.org"), (3, "http://bad.org", None)],
        "i int, u string, f string",
    )
    rows = policy.restricted_redirects(visits, blocklist, "i", "u", "f").orderBy("i").collect()
    bad = "Domain contains restricted content"
    assert [(r.f, r.error) for r in rows] == [("http://bad.org", bad), ("http://b.org", None), ("http://bad.org", bad)]


def test_suspicious(spark):
    filler = "w " * 9
    cases = {
        "x.onion private content": True,
        "x.onion hello": False,
        "escort services private content": False,
        "escortservices secret dm": True,
        f"x.onion {filler}private content": False,
        f"x.onion {'w ' * 7}private content": True,
        f"private content {'w ' * 8}x.onion": True,
        f"private content {'w ' * 9}x.onion": False,
        f"x.onion {'w ' * 30}y.onion private content": False,
        "PAYMENTFORCONTENT Money\n required": True,
        "buyadultpic adult  material": True,
        "18+only xxx content": True,
        None: False,
        "": False,
    }
    assert texts(spark, list(cases), policy.is_suspicious(F.col("t"))) == list(cases.values())


def test_keyword_combinations(spark):
    values = ["Privately showing payments", "send pic", "crypto CONTENT unprivate", None]
    assert texts(spark, values, policy.has_keyword_combination(F.col("t"))) == [
        True, False, True, False,
    ]


def test_sentiment(spark):
    lexicon = spark.createDataFrame(
        [("bad", Decimal("-1")), ("good", Decimal("0.5"))], "word string, polarity decimal(9,4)"
    )
    docs = spark.createDataFrame(
        [(1, "Bad  bad"), (2, ""), (3, "not good bad"), (4, "good not")], "i int, t string"
    )

    def scores(*negations):
        rows = policy.sentiment_scores(docs, "i", "t", lexicon, negations).orderBy("i").collect()
        return [(r.n_tokens, round(r.score, 6)) for r in rows]

    assert scores() == [(3, -0.666667), (1, 0.0), (3, -0.166667), (2, 0.25)]
    assert scores("not") == [(3, -0.666667), (1, 0.0), (3, 0.166667), (2, 0.25)]


def test_sentiment_flags(spark):
    df = spark.createDataFrame([(-0.95,), (-0.9,), (-0.8,), (-0.7,)], "s double")
    assert [r.v for r in df.select(policy.sentiment_flag(F.col("s")).alias("v")).collect()] == [
        "extremely_negative_sentiment", "negative_sentiment", "negative_sentiment", None,
    ]


def test_validation(spark, blocklist):
    lexicon = spark.createDataFrame([("bad", Decimal("-1"))], "word string, polarity decimal(9,4)")
    docs = spark.createDataFrame(
        [
            (1, "   "),
            (2, "bad.org/x private show payment"),
            (3, "bad bad bad"),
            (4, "fine"),
            (5, "also fine"),
        ],
        "i int, t string",
    )
    verdicts = spark.createDataFrame([(4, "unsafe"), (5, "UNSAFE"), (1, "unsafe")], "i int, verdict string")
    rows = policy.validate_content(docs, "i", "t", blocklist, lexicon, verdicts).orderBy("i").collect()
    assert [(r.is_valid, r.reason, r.flags) for r in rows] == [
        (False, "Empty content", None),
        (
            False,
            "Contains restricted domain; Contains suspicious keyword combinations",
            ["restricted_domain", "keyword_combinations"],
        ),
        (False, "Contains extremely negative sentiment", ["extremely_negative_sentiment"]),
        (False, "Flagged by AI safety check", ["ai_safety_check"]),
        (True, None, None),
    ]
    loose = policy.validate_content(docs, "i", "t", blocklist, lexicon, verdicts, compare="ci")
    assert [r.i for r in loose.filter("is_valid").collect()] == []
    with pytest.raises(ValueError):
        policy.is_unsafe(F.lit("x"), "other")


def test_processed_content(spark):
    pages = spark.createDataFrame([(i, " " if i == 1 else "a xxx") for i in range(1, 8)], "i int, t string")
    answers = spark.createDataFrame(
        [
            (1, "r", None, True), (2, "r", None, True), (3, "r", None, False),
            (4, None, "error 429", None), (5, None, "closed", None), (6, "", None, None),
        ],
        "i int, response string, response_error string, response_valid boolean",
    )

    def run(mode):
        rows = policy.processed_content(pages, "i", "t", answers, mode).orderBy("i").collect()
        return [r.processed for r in rows]

    assert run("filtered") == ["", "a  ", "a  ", "a  ", "", "", ""]
    assert run("response") == ["", "r", "a  ", "a  ", "", "", ""]
    with pytest.raises(ValueError):
        run("other")


def test_credentials(spark):
    key = "AIza" + "a-_9" * 8 + "xyz"
    df = spark.createDataFrame(
        [("s", f"x {key}\n{key} {key}1"), ("s", f"({key})"), ("t", "AIza"), ("u", None)],
        "s string, t string",
    )
    rows = policy.credential_shapes(df, "t", "s").collect()
    assert {r.s: r.n_keys for r in rows} == {"s": 2, "t": 0, "u": 0}


def test_signals(spark):
    cases = {
        "<H1 a=b>x</h2>": ["structured"],
        "<h1>" + "x" * 5000 + "</h1>": ["structured"],
        "<h1>" + "x" * 50_001 + "</h1>": ["structured"],
        "</h1>" + "<h1>" * 3: [],
        "<header>x</header>": [],
        "<h1>" + "x" * 6000 + "<h2>y</h2>": ["structured"],
        "<ul>\n<li></ol> <table></table>": ["list", "data"],
        "Pricey": ["price"],
        "$ 5 $a": [],
        "costs $5, POSTED BY me, About Me": ["price", "article", "bio"],
    }
    assert texts(spark, list(cases), classify.content_signals(F.col("t"))) == list(cases.values())
    late = " " * 50 + "<h1>x</h1> author"
    assert texts(spark, [late], classify.content_signals(F.col("t"), 20)) == [["article"]]
    long = "<h1>" + "x" * 5001 + "</h1>"
    assert texts(spark, [long], classify.content_signals(F.col("t"), body_limit=5000)) == [[]]


def test_page_types_and_prompts(spark):
    df = spark.createDataFrame(
        [
            (1, "https://a.org/posts", "x"),
            (2, "https://a.org/Blog", "x"),
            (3, "https://a.org/", "price and author $1 \\1 {content}"),
            (4, "https://a.org/x?q=/blog", "price"),
            (5, "https://a.org/shop/category", "x"),
            (6, "https://a.org/s", "<ul></ul> profile"),
            (7, "https://a.org/s", "my profile"),
        ],
        "i int, url string, t string",
    )
    templates = spark.createDataFrame(
        [("article", "narrative", "A {content} {content}"), ("profile", "descriptive", "no place")],
        "page_type string, structure_type string, template string",
    )
    typed = classify.classify_pages(df, "url", "t")
    rows = classify.build_prompts(typed, "t", templates, "i", "d: {content}").orderBy("i").collect()
    assert [r.page_type for r in rows] == [
        "article", "general", "article", "product", "product", "category", "profile",
    ]
    assert rows[2].prompt == "A price and author $1 \\1 {content} {content}"
    assert rows[1].prompt == "d: x"
    assert rows[5].prompt == "d: <ul></ul> profile"
    assert rows[6].prompt == "no place"
    plain = classify.build_prompts(typed, "t", templates.limit(0), "i").orderBy("i").collect()
    assert [r.prompt for r in plain][:2] == ["x", "x"]


def brute_rules(texts, table):
    out = []
    for i, t in texts:
        for r, words in table:
            words = [w.lower() for w in words or [] if w]
            if words and t is not None and all(w in t.lower() for w in words):
                out.append((i, r))
    return sorted(out)


def test_many_rules_match_as_one_by_one(spark):
    rng = random.Random(4)
    syllables = ["ka", "to", "mi", "re", "su", "no"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    texts = [(i, " ".join(word().upper() if rng.random() < 0.2 else word() for _ in range(60))) for i in range(150)] + [(900, None), (901, "")]
    table = [(r, [word() for _ in range(rng.randint(1, 4))]) for r in range(10_000)]
    table += [(20_000, []), (20_001, None), (20_002, ["", None]), (20_003, ["KATO", "kato"]), (20_004, ["zzz", "ka"]), (20_005, ["o n"])]
    docs = spark.createDataFrame(texts, "row bigint, t string")
    frame = spark.createDataFrame(table, "rule bigint, words array<string>")
    found = rules.rule_matches(docs, "row", "t", frame, "rule", "words")
    assert sorted(map(tuple, found.collect())) == brute_rules(texts, table)
    few = frame.filter("rule < 300 OR rule >= 20000")
    parts = rules.rule_matches(docs, "row", "t", few, "rule", "words", block=50)
    assert sorted(map(tuple, parts.collect())) == brute_rules(texts, [r for r in table if r[0] < 300 or r[0] >= 20_000])


def test_a_rule_costs_no_more_for_a_text_of_many_keywords(spark):
    """Texts that hold all keywords, and rules that all match them."""
    names = [f"w{i:04d}x" for i in range(3000)]
    docs = spark.range(300).repartition(8).select(F.col("id").alias("row"), F.lit(" ".join(names)).alias("t"))
    frame = spark.createDataFrame([(r, [names[r % 3000], names[r * 7 % 2999], names[r * 13 % 2998]]) for r in range(12_000)], "rule bigint, words array<string>")
    start = time.time()
    found = rules.rule_matches(docs, "row", "t", frame, "rule", "words")
    assert found.agg(F.count("*"), F.count_distinct("row", "rule")).first()[:] == (300 * 12_000, 300 * 12_000)
    assert time.time() - start < 30


def test_sets_of_several_passes_match_alike(spark):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(9))) for i in range(60)] + [(None, "ax by"), (None, "ax by")]
    table = [(r % 50, [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randint(1, 3))]) for r in range(100)]
    table = list({(r, tuple(dict.fromkeys(w))) for r, w in table}) + [(None, ("ax",))]
    docs = spark.createDataFrame(texts, "row bigint, t string")
    frame = spark.createDataFrame([(r, list(w)) for r, w in table] * 2, "rule bigint, words array<string>")
    found = rules.rule_matches(docs, "row", "t", frame, "rule", "words", block=20)
    key = lambda pair: tuple(-1 if x is None else x for x in pair)
    expected = [(i, r) for i, t in texts for r, words in table if all(w in t for w in words)]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_rules_are_not_checked_text_by_text(spark):
    """Ten thousand million pairs of text and rule, of which some hundred match."""
    n, moduli = 100_000, (331, 317, 313)
    parts = lambda factors: [F.concat(F.lit(c), F.col("id") * f % m, F.lit("x")) for c, f, m in zip("abc", factors, moduli, strict=True)]
    docs = spark.range(n, numPartitions=8).select(F.col("id").alias("row"), F.concat_ws(" ", *parts((1, 7, 11))).alias("t"))
    frame = spark.range(n).select(F.col("id").alias("rule"), F.array(*parts((1, 1, 1))).alias("words"))
    start = time.time()
    found = rules.rule_matches(docs, "row", "t", frame, "rule", "words")
    rows = sorted(map(tuple, found.collect()))
    assert time.time() - start < 20
    of = {tuple(r % m for m in moduli): r for r in range(n)}
    held = ((t, of.get(tuple(t * f % m for f, m in zip((1, 7, 11), moduli, strict=True)))) for t in range(n))
    assert rows == [(t, r) for t, r in held if r is not None] and len(rows) > 100
    # Pairs are neither moved nor joined to anything.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_many_texts_and_rules_in_one_batch(spark):
    """More texts than are read at once, a text of more rules than a row of results, and keywords with blanks."""
    rng = random.Random(12)
    word = lambda: rng.choice(["ka", "to", "mi", "straße", "x\ny", "é"]) + rng.choice("abcdefgh")
    texts = [(f"t{i}", None if i % 97 == 0 else " ".join(word() for _ in range(i % 7))) for i in range(rules.TEXTS + 200)]
    texts += [("all", " ".join(f"q{i:04d}" for i in range(rules.LIST + 10)))] + [(None, "KAA  TOB"), (None, "KAA  TOB")]
    table = [(r, [w() for w in [word] * rng.randint(1, 5)]) for r in range(150)] + [(r, [f"{word()} {word()}"]) for r in range(200, 220)]
    table += [(300, [" "]), (301, ["  "]), (302, ["aa  to", "b"]), (None, ["kaa"]), (303, ["sse"])]
    table += [(1000 + i, [f"Q{i:04d}"]) for i in range(rules.LIST + 10)]
    docs = spark.createDataFrame(texts, "row string, t string").coalesce(1)
    frame = spark.createDataFrame([(None if r is None else f"r{r}", w) for r, w in table], "rule string, words array<string>")
    found = rules.rule_matches(docs, "row", "t", frame, "rule", "words")
    named = [(None if r is None else f"r{r}", w) for r, w in table]
    key = lambda pair: tuple(x or "" for x in pair)
    sought = [(r, [w.lower() for w in words]) for r, words in named]
    expected = [(i, r) for i, t in texts if t for r, words in sought if all(w in t.lower() for w in words)]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expected, key=key)


def test_a_pass_is_bounded_by_letters_and_by_what_rules_name(spark):
    passes = lambda found: found._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    names = [f"{i:02d}" * 25 for i in range(60)]
    docs = spark.createDataFrame([(i, f"{names[i]} {names[-1]} ab") for i in range(60)], "row bigint, t string")
    long = spark.createDataFrame([(i, [names[i]]) for i in range(60)], "rule bigint, words array<string>")
    found = rules.rule_matches(docs, "row", "t", long, "rule", "words", block=10)  # 3000 letters, 400 a pass
    assert passes(found) == 8
    assert sorted(map(tuple, found.collect())) == sorted({(i, r) for i in range(60) for r in (i, 59)})
    same = spark.createDataFrame([(i, ["ab"]) for i in range(100)], "rule bigint, words array<string>")
    found = rules.rule_matches(docs, "row", "t", same, "rule", "words", block=1)  # 2 letters, named 100 times
    assert passes(found) == 5
    assert sorted(map(tuple, found.collect())) == [(i, r) for i in range(60) for r in range(100)]


def test_words_of_rules_are_cut_out_of_the_texts_alike(spark, tmp_path):
    texts = ["A b  C d E f G h", "one", "", None, "x Σ Σ ΑΣ yΣ zΣ ΟΔΟΣ Σa", "1 2 3 4 5 6 7", "İ I ß\nQ Ö  É", " lead ing a b c d"]
    spark.createDataFrame([*enumerate(texts), (1, "again A b C d e f"), (None, "no id a b c d e")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i,) for i in [*range(8), 1, 0, 99, None]], "doc_id bigint").write.parquet(f"{tmp_path}/labels.parquet")
    before = derived.derive(spark, str(tmp_path), derived.RULES).select("rule_id", F.array("a", "b", "c").alias("keywords"))
    found = derived.rules(spark, str(tmp_path))
    assert found.schema["rule_id"].dataType == before.schema["rule_id"].dataType and found.columns == before.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, before.collect())) and found.count() == 12


def test_rules_or_texts_may_be_missing(spark):
    docs = spark.createDataFrame([(1, "a b")], "row bigint, t string")
    none = spark.createDataFrame([], "rule bigint, words array<string>")
    assert rules.rule_matches(docs, "row", "t", none, "rule", "words").collect() == []
    one = spark.createDataFrame([(1, ["a"])], "rule bigint, words array<string>")
    assert rules.rule_matches(docs.limit(0), "row", "t", one, "rule", "words").collect() == []


# From the paper that describes the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled
motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss
fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc
hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog
vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler
probate probat rate rate cease ceas controll control roll roll by by y y yes ye youth youth saying sai a1ing a1ing""".split()


def test_stems(spark):
    words = dict(zip(STEMS[::2], STEMS[1::2]))
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", porter_stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in found.collect()} == words


def test_tokens_count_by_themselves_or_their_stem(spark):
    docs = spark.createDataFrame([(1, "He hopes hoping HOPED hope"), (2, "ponies poni pony"), (3, None), (4, "none")], "row bigint, t string")
    lexicon = spark.createDataFrame([("hope", Decimal("0.5")), ("hoping", Decimal("0.25")), ("Ponies", Decimal("-1"))], "word string, polarity decimal(9,4)")
    found = policy.stemmed_lexicon(docs, "t", lexicon)
    assert {r.word: float(r.polarity) for r in found.collect()} == {
        "hopes": 0.25, "hoping": 0.25, "hoped": 0.25, "hope": 0.25, "ponies": -1.0, "poni": -1.0, "pony": -1.0
    }
    # A token is stemmed in what the grouping of equal tokens returns, so once.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("regexp_extract" in line for line in plan.split("\n") if "Aggregate [word" in line)
    assert not any("regexp" in line for line in plan.split("\n") if "Generate" in line)
