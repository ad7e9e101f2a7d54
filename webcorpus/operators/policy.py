"""Domain and content policy: blocklists, phrase masks, flags and their reasons."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.functions.common import SPACE, WORD_EDGE, is_blank, let
from webcorpus.functions.stems import porter_stem
from webcorpus.functions.text import mask_phrases
from webcorpus.functions.urls import domain_key
from webcorpus.operators.joins import lookup_join

# Restricted endings and beginnings of a domain key.
RESTRICTED_ENDING = r"(?i)\.(?:xxx|sex|adult|porn)\z"
RESTRICTED_START = r"(?i)^(?:porn|xxx|adult|sex)[-.]"
RESTRICTED_ERROR = "Domain contains restricted content"

# Words that make a text suspicious when a context pattern is near them.
SUSPICIOUS_WORDS = [
    rf"{WORD_EDGE}(?:www\.)?[a-z0-9-]+\.(?:xxx|adult|porn){WORD_EDGE}",
    rf"\.onion{WORD_EDGE}",
    rf"{WORD_EDGE}(?:escort|adult(?:{SPACE}|-)massage){SPACE}*services?{WORD_EDGE}",
    rf"{WORD_EDGE}(?:18\+{SPACE}*(?:explicit|only)){WORD_EDGE}",
    rf"{WORD_EDGE}(?:buy|sell|trade){SPACE}*(?:adult{SPACE}*)?(?:pic|video|content){WORD_EDGE}",
    rf"(?:crypto|bitcoin|payment){SPACE}*(?:for|to){SPACE}*(?:content|service)",
]
SUSPICIOUS_CONTEXT = [
    rf"(?:payment|money|crypto){SPACE}+(?:required|needed|only)",
    rf"(?:private|secret){SPACE}+(?:content|message|dm)",
    rf"(?:adult|xxx){SPACE}+(?:content|material)",
]
CONTEXT_WORDS = 10

# Each suspicious word, and each context, contains one of these.
_WORD_HINTS = [".xxx", ".adult", ".porn", ".onion", "service", "18+", "pic", "video", "content"]
_CONTEXT_HINTS = ["payment", "money", "crypto", "private", "secret", "adult", "xxx"]

# Keywords that are unsafe when all of one list occur.
KEYWORD_COMBINATIONS = [
    ["private", "show", "payment"],
    ["send", "pic", "money"],
    ["buy", "content", "private"],
    ["trade", "content", "direct"],
    ["crypto", "content", "private"],
]

# Sentiment thresholds.
NEGATIVE = -0.7
EXTREMELY_NEGATIVE = -0.9

# Sentence for each flag.
FLAG_REASONS = {
    "restricted_domain": "Contains restricted domain",
    "inappropriate_content": "Contains inappropriate content",
    "suspicious_patterns": "Contains suspicious patterns",
    "keyword_combinations": "Contains suspicious keyword combinations",
    "extremely_negative_sentiment": "Contains extremely negative sentiment",
    "negative_sentiment": "Contains negative sentiment",
    "ai_safety_check": "Flagged by AI safety check",
    "validation_error": "Validation error occurred",
}

# Fixed value: shape of a service key.
KEY_SHAPE = r"AIza[0-9A-Za-z\-_]{35}"


def _lookup_key(domain: Column) -> Column:
    """Join key of a domain; texts may be of any length, so the key is a hash."""
    return F.sha2(domain, 256)


def load_blocklist(entries: DataFrame, column: str) -> DataFrame:
    """Distinct normalised domains of a blocklist table."""
    return entries.select(domain_key(F.col(column)).alias("domain")).distinct()


def restricted_name(domain: Column) -> Column:
    """True when the domain key itself gives the site away."""
    return domain.rlike(RESTRICTED_ENDING) | domain.rlike(RESTRICTED_START)


def flag_restricted(
    df: DataFrame, text: str, blocklist: DataFrame, row_id: str, out: str = "restricted"
) -> DataFrame:
    """Add a flag: listed domain, restricted ending or restricted start."""
    named = name_flags(df, domain_key(F.col(text)))
    return flag_names(named, blocklist, row_id, out)


def name_flags(df: DataFrame, name: Column) -> DataFrame:
    """Reduce a domain key to a hash and what its form gives away."""
    form = F.coalesce(restricted_name(name), F.lit(False))
    return df.withColumns({"_key": _lookup_key(name), "_form": form})


def flag_names(named: DataFrame, blocklist: DataFrame, row_id: str, out: str) -> DataFrame:
    """Flag rows of ``name_flags`` that are listed or restricted by their form."""
    listed = blocklist.select(_lookup_key(F.col("domain")).alias("_key")).withColumn(
        "_listed", F.lit(True)
    )
    joined = lookup_join(named, listed, "_key", spread_by=row_id)
    flag = F.coalesce(F.col("_listed"), F.lit(False)) | F.col("_form")
    return joined.withColumn(out, flag).drop("_key", "_form", "_listed")


def restricted_redirects(
    visits: DataFrame, blocklist: DataFrame, row_id: str, requested: str, final: str
) -> DataFrame:
    """Add an error where the requested or the final URL is restricted.

    A visit without a known final URL ended where it was requested.
    """
    known = visits.withColumn(final, F.coalesce(final, requested))
    flagged = flag_restricted(known, requested, blocklist, row_id, "_first")
    flagged = flag_restricted(flagged, final, blocklist, row_id, "_last")
    return flagged.withColumn(
        "error", F.when(F.col("_first") | F.col("_last"), RESTRICTED_ERROR)
    ).drop("_first", "_last")


def is_key_shaped(text: Column) -> Column:
    return text.rlike(rf"^{KEY_SHAPE}\z")


def credential_shapes(texts: DataFrame, text: str, source: str) -> DataFrame:
    """Whitespace-separated tokens that look like service keys, counted per source."""
    tokens = F.split(F.col(text), rf"{SPACE}+")
    hits = F.when(
        F.col(text).contains("AIza"), F.size(F.filter(tokens, is_key_shaped))
    ).otherwise(0)
    return texts.groupBy(source).agg(F.sum(hits).cast("bigint").alias("n_keys"))


def is_quota_error(error: Column) -> Column:
    return error.contains("429") | error.contains("quota")


def error_class(results: DataFrame, error: str = "error") -> DataFrame:
    """Failed rows by kind of error."""
    kind = F.when(is_quota_error(F.col(error)), "quota").otherwise("other")
    failed = results.filter(F.col(error).isNotNull())
    return failed.groupBy(kind.alias("error_class")).agg(F.count("*").alias("n"))


def mask_array(texts: Column, first_only: bool = True) -> Column:
    """Masked texts joined by newlines."""
    return F.array_join(F.transform(texts, lambda t: mask_phrases(t, first_only)), "\n")


def is_suspicious(text: Column) -> Column:
    """A suspicious word with a context pattern among the words around it.

    For each pattern only its first matching word counts; the context is the ten words before
    it, the word and the nine words after it.
    """

    def near(words: Column, pattern: str) -> Column:
        at = F.array_position(F.transform(words, lambda w: w.rlike(pattern)), True).cast("int")
        start = F.greatest(at - 1 - CONTEXT_WORDS, F.lit(0))
        stop = F.least(F.size(words), at - 1 + CONTEXT_WORDS)
        context = F.array_join(F.slice(words, start + 1, stop - start), " ")
        return (at > 0) & let(
            context, lambda c: reduce(or_, (c.rlike(p) for p in SUSPICIOUS_CONTEXT))
        )

    lowered = F.lower(text)
    any_word = reduce(or_, (lowered.rlike(p) for p in SUSPICIOUS_WORDS))
    any_context = reduce(or_, (lowered.rlike(p) for p in SUSPICIOUS_CONTEXT))
    found = let(
        F.split(lowered, rf"{SPACE}+"),
        lambda words: reduce(or_, (near(words, p) for p in SUSPICIOUS_WORDS)),
    )
    # A word match is also a match in the whole text, and so is a context match up to the kind
    # of whitespace: most texts are settled by their hints, without being split.
    hinted = reduce(or_, (lowered.contains(h) for h in _CONTEXT_HINTS)) & reduce(
        or_, (lowered.contains(h) for h in _WORD_HINTS)
    )
    return F.coalesce(
        F.when(hinted, F.when(any_context & any_word, found)).otherwise(False), F.lit(False)
    )


def has_keyword_combination(text: Column) -> Column:
    lowered = F.lower(text)
    lists = (
        reduce(and_, (lowered.contains(word) for word in words)) for words in KEYWORD_COMBINATIONS
    )
    return F.coalesce(reduce(or_, lists), F.lit(False))


def sentiment_scores(
    texts: DataFrame,
    row_id: str,
    text: str,
    lexicon: DataFrame,
    negations: tuple[str, ...] = (),
) -> DataFrame:
    """Mean polarity over the blank-separated tokens of each text: (row_id, n_tokens, score).

    ``lexicon`` is (word, polarity decimal). Empty tokens from doubled blanks count. After the
    first of ``negations`` the polarities change sign. Tokens of one text are added up before
    they are shuffled, and the text itself never is.
    """
    words = lexicon.select(F.lower("word").alias("token"), "polarity").dropDuplicates(["token"])
    tokens = texts.select(
        row_id, F.posexplode(F.split(F.lower(F.col(text)), " ")).alias("_pos", "token")
    )
    if negations:
        first = F.array_position(
            F.transform(F.col("_tokens"), lambda t: t.isin(*negations)), True
        )
        tokens = (
            texts.select(row_id, F.split(F.lower(F.col(text)), " ").alias("_tokens"))
            .select(row_id, first.alias("_first"), F.posexplode("_tokens").alias("_pos", "token"))
        )
        sign = F.when((F.col("_first") > 0) & (F.col("_pos") >= F.col("_first")), -1).otherwise(1)
    else:
        sign = F.lit(1)
    scored = lookup_join(tokens, words, "token", spread_by=[row_id, "_pos"])
    polarity = F.coalesce(F.col("polarity"), F.lit(0)).cast("decimal(9,4)") * sign.cast("int")
    sums = scored.groupBy(row_id).agg(
        F.count("*").alias("n_tokens"), F.sum(polarity).cast("double").alias("_sum")
    )
    return sums.select(row_id, "n_tokens", (F.col("_sum") / F.col("n_tokens")).alias("score"))


def stemmed_lexicon(texts: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """(word, polarity) of the tokens of ``texts`` that a lexicon knows by themselves or by their stem.

    The lexicon's words are stemmed; of words with one stem the last in order counts. A token that
    is such a stem itself counts as that, any other by its own stem. Each distinct token is stemmed
    once, whatever number of texts hold it.
    """
    stems = (
        lexicon.select(F.lower("word").alias("_word"), "polarity")
        .groupBy(porter_stem(F.col("_word")).alias("_stem"))
        .agg(F.max_by("polarity", "_word").alias("polarity"))
    )
    tokens = texts.select(F.explode(F.split(F.lower(F.col(text)), " ")).alias("word")).distinct()
    stemmed = tokens.withColumn("_own", porter_stem(F.col("word")))
    direct = stems.select(F.col("_stem").alias("word"), F.col("polarity").alias("_direct"))
    known = lookup_join(lookup_join(stemmed, direct, "word"), stems.withColumnRenamed("_stem", "_own"), "_own")
    return known.select("word", F.coalesce("_direct", "polarity").alias("polarity")).filter("polarity IS NOT NULL")


def sentiment_flag(score: Column) -> Column:
    return F.when(score < EXTREMELY_NEGATIVE, "extremely_negative_sentiment").when(
        score < NEGATIVE, "negative_sentiment"
    )


def is_unsafe(verdict: Column, compare: str = "exact") -> Column:
    """Does a model's verdict say unsafe? ``exact`` wants lower case, ``ci`` takes any case."""
    if compare not in ("exact", "ci"):
        raise ValueError(f"unknown comparison: {compare}")
    said = verdict if compare == "exact" else F.lower(verdict)
    return F.coalesce(said == "unsafe", F.lit(False))


def flag_reasons(flags: Column) -> Column:
    """Sentences for the known flags, joined by '; '."""
    known = F.create_map(*(F.lit(x) for pair in FLAG_REASONS.items() for x in pair))
    return F.array_join(F.array_compact(F.transform(flags, lambda f: known[f])), "; ")


def validate_content(
    texts: DataFrame,
    row_id: str,
    text: str,
    blocklist: DataFrame,
    lexicon: DataFrame,
    verdicts: DataFrame,
    keep: tuple[str, ...] = (),
    compare: str = "exact",
) -> DataFrame:
    """(row_id, is_valid, reason, flags) for each text; flags and reason are NULL when clean.

    ``verdicts`` is (row_id, verdict); a missing verdict raises no flag. The text is reduced to
    its flags before anything is shuffled, so the joins move a few bytes per row.
    """
    content = F.col(text)
    narrow = name_flags(texts, domain_key(content)).select(
        row_id,
        *keep,
        "_key",
        "_form",
        is_blank(content).alias("_blank"),
        F.when(is_suspicious(content), "suspicious_patterns").alias("_pattern"),
        F.when(has_keyword_combination(content), "keyword_combinations").alias("_words"),
    )
    narrow = flag_names(narrow, blocklist, row_id, "_listed_name").withColumn(
        "_domain", F.when(F.col("_listed_name"), "restricted_domain")
    )
    scores = sentiment_scores(texts, row_id, text, lexicon)
    joined = narrow.join(scores, row_id, "left").join(verdicts, row_id, "left")
    found = F.array_compact(
        F.array(
            "_domain",
            "_pattern",
            "_words",
            sentiment_flag(F.col("score")),
            F.when(is_unsafe(F.col("verdict"), compare), "ai_safety_check"),
        )
    )
    flags = F.when(~F.col("_blank") & (F.size("_found") > 0), F.col("_found"))
    flagged = joined.withColumn("_found", found).withColumn("flags", flags)
    return flagged.select(
        row_id,
        *keep,
        (~F.col("_blank") & F.col("flags").isNull()).alias("is_valid"),
        F.when(F.col("_blank"), "Empty content")
        .when(F.col("flags").isNotNull(), flag_reasons(F.col("flags")))
        .alias("reason"),
        "flags",
    )


def flag_counts(validated: DataFrame, source: str) -> DataFrame:
    """How often each flag was raised per source."""
    rows = validated.select(source, F.explode("flags").alias("flag"))
    return rows.groupBy(source, "flag").agg(F.count("*").alias("n"))


def processed_content(
    pages: DataFrame,
    row_id: str,
    content: str,
    responses: DataFrame,
    mode: str = "filtered",
    first_only: bool = True,
) -> DataFrame:
    """Add ``processed``: the masked content, or '' for blank pages and failed calls.

    ``responses`` is (row_id, response, response_error, response_valid). Quota errors fall back
    to the masked content; other errors and missing responses give ''. With ``mode="response"``
    a valid response replaces the content.
    """
    if mode not in ("filtered", "response"):
        raise ValueError(f"unknown mode: {mode}")
    text = F.col(content)
    masked = mask_phrases(text, first_only)
    error, answer = F.col("response_error"), F.col("response")
    answered = F.when(F.col("response_valid"), answer).otherwise(masked)
    missing = answer.isNull() | (answer == "")
    processed = (
        F.when(is_blank(text), "")
        .when(is_quota_error(error), masked)
        .when(error.isNotNull() | missing, "")
        .otherwise(answered if mode == "response" else masked)
    )
    return (
        pages.join(responses, row_id, "left")
        .withColumn("processed", processed)
        .drop("response", "response_error", "response_valid")
    )
