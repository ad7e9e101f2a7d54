"""Secrets in texts through a trigram inverted index; DataFrame functions only.

From each rule's expression a Boolean query over the trigrams that any match must hold is derived.
The index has the postings of all trigrams that the queries ask for, in segments of bounded size; a
rule's candidates come from intersecting and uniting postings, and only candidates are verified by
the expression itself. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.common import stored

SEGMENT = 4096  # texts per segment of the index, about
EXPAND = 8  # a character class is spelt out up to this size
STRINGS = 64  # and so are the strings of a part of an expression
MASK = "[SECRET]"


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Fixed values. Runs of the hex rule are maximal, so its length bound may stand in the expression;
# so it may for the access rule, as a later start in the same run is shorter still.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

# A query is None (anything), a trigram, or ("and" | "or", queries).
Query = None | str | tuple


def _all(queries: list[Query]) -> Query:
    parts = sorted({q for q in queries if q is not None}, key=str)
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(queries: list[Query]) -> Query:
    if not queries or any(q is None for q in queries):
        return None
    parts = sorted(set(queries), key=str)
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(strings: set[str]) -> Query:
    return _any([_all([s[k : k + 3] for k in range(len(s) - 2)]) for s in strings])


def _sequence(items: list) -> tuple[set[str] | None, Query]:
    """The strings that a sequence of parsed parts stands for, or None; and what any match holds."""
    run: set[str] = {""}
    found: list[Query] = []
    exact = True
    for item in items:
        strings, query = _part(item)
        if strings is not None and len(run) * len(strings) <= STRINGS:
            run = {a + b for a in run for b in strings}
            continue
        exact = False
        found.append(_strings(run))
        found.append(query if strings is None else None)
        run = {""} if strings is None else strings
    if exact:
        return run, _strings(run)
    return None, _all([*found, _strings(run)])


def _part(item: tuple) -> tuple[set[str] | None, Query]:
    op, value = item
    if op is sre.LITERAL:
        return {chr(value).lower()}, None
    if op is sre.IN:
        chars: set[str] = set()
        for kind, x in value:
            if kind is sre.LITERAL:
                chars.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < EXPAND:
                chars.update(chr(c).lower() for c in range(x[0], x[1] + 1))
            else:
                return None, None
        return (chars, None) if len(chars) <= EXPAND else (None, None)
    if op is sre.SUBPATTERN:
        return _sequence(list(value[3]))
    if op is sre.BRANCH:
        sides = [_sequence(list(s)) for s in value[1]]
        if all(s is not None for s, _ in sides) and sum(len(s) for s, _ in sides) <= STRINGS:
            whole = set().union(*(s for s, _ in sides))
            return whole, _strings(whole)
        return None, _any([q for _, q in sides])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
        low, high, body = value
        strings, query = _sequence(list(body))
        if strings is not None and high == 1:
            return (strings | {""} if low == 0 else strings), None
        return None, (query if low else None)
    if op is sre.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of an expression over lower-cased text; None: no trigram is mandatory."""
    return _sequence(list(_parser.parse(pattern)))[1]


def trigrams(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def clauses(query: str | tuple) -> list[frozenset[str]]:
    """The query as alternatives, each a set of trigrams that must all be there.

    A conjunction that would give more than ``STRINGS`` alternatives keeps only its shortest part,
    which any match satisfies as well.
    """
    if isinstance(query, str):
        return [frozenset((query,))]
    sides = [clauses(q) for q in query[1]]
    if query[0] == "or":
        return sorted(set().union(*sides), key=sorted)
    whole: list[frozenset[str]] = [frozenset()]
    for side in sorted(sides, key=len):
        if len(whole) * len(side) <= STRINGS:
            whole = [a | b for a in whole for b in side]
    return sorted(set(whole), key=sorted)


def _candidates(index: DataFrame, ways: list[tuple[int, frozenset[str]]]) -> DataFrame:
    """(key, kind): postings intersected per alternative in each segment, and united."""
    maps = index.groupBy("segment").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("posting"))
    literal = F.array(*(F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, sorted(w))).alias("grams")) for k, w in ways))
    each = maps.select("posting", F.inline(literal))
    none = F.array().cast("array<bigint>")
    lists = F.transform("grams", lambda g: F.coalesce(F.try_element_at("posting", g), none))
    rest = F.slice("lists", 2, F.greatest(F.size("lists") - 1, F.lit(0)))
    common = F.aggregate(rest, F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    keys = each.select("kind", lists.alias("lists")).select("kind", F.explode(common).alias("key"))
    return keys.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _lengths(text: Column, rule: Rule) -> Column:
    """For each match in order: characters before it since the last one, in it, and in its group."""
    before = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    group = matches if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    whole = F.arrays_zip(F.slice(before, 1, F.size(matches)).alias("gap"), matches.alias("size"), group.alias("held"))
    return F.when(text.rlike(rule.pattern), whole)


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key) of every row, and (key, kind, start, end) of every match, code points, end exclusive.

    ``key`` is a hash of id and text: wholly equal rows share one. ``kind`` is the rule's position.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    scanned = [k for k, q in enumerate(queries) if q is None]
    indexed = [k for k, q in enumerate(queries) if q is not None]
    grams = sorted(set().union(*map(trigrams, queries)))
    plain = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", plain.alias("text"), F.xxhash64("doc_id", plain).alias("key"))
    low = F.lower("text")
    held = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), g) for g in grams)) if grams else F.array().cast("array<string>"))
    scans = F.array_compact(
        F.array(*(F.when(F.col("text").rlike(rules[k].pattern), F.struct(F.lit(k).alias("kind"), _lengths(F.col("text"), rules[k]).alias("found"))) for k in scanned))
        if scanned
        else F.array().cast("array<struct<kind:int,found:array<struct<gap:int,size:int,held:int>>>>")
    )
    # One pass over the texts; what it leaves is narrow.
    table = stored(rows.withColumn("low", low).select("doc_id", "key", held.alias("grams"), scans.alias("scans")))
    verified = table.select("key", F.inline("scans"))
    if indexed:
        segments = max(1, -(-table.count() // segment))
        index = stored(
            table.select("key", F.explode("grams").alias("gram"))
            .groupBy(F.pmod("key", F.lit(segments)).alias("segment"), "gram")
            .agg(F.collect_set("key").alias("keys"))
        )
        ways = [(k, way) for k in indexed for way in clauses(queries[k])]
        candidates = _candidates(index, ways)
        # Texts move only if they hold the rarest trigram of some way to match.
        counts = {r["gram"]: r["n"] for r in index.groupBy("gram").agg(F.sum(F.size("keys")).alias("n")).collect()}
        rare = sorted({min(way, key=lambda g: (counts.get(g, 0), g)) for _, way in ways})
        may = reduce(or_, (F.contains(F.lower("text"), F.lit(g)) for g in rare))
        tested = F.array(
            *(
                F.when(F.array_contains("kinds", k), F.struct(F.lit(k).alias("kind"), _lengths(F.col("text"), rules[k]).alias("found")))
                for k in indexed
            )
        )
        checked = rows.filter(may).join(candidates, "key").select("key", F.inline(F.array_compact(tested)))
        verified = verified.unionByName(checked)
    # Wholly equal rows found the same: one of them stays.
    once = verified.filter("found IS NOT NULL").groupBy("key", "kind").agg(F.first("found").alias("found"))
    each = once.select("key", "kind", F.posexplode("found").alias("pos", "m")).select("key", "kind", "pos", "m.*")
    so_far = Window.partitionBy("key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = each.select("key", "kind", "size", "held", end.alias("end"))
    enough = F.lit(False)
    for k, rule in enumerate(rules):
        enough = enough | ((F.col("kind") == k) & (F.col("held") >= rule.least))
    return table.select("doc_id", "key"), placed.filter(enough).select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")


def op2(docs: DataFrame) -> DataFrame:
    """Counts and spans of the secrets of every row; NULL and empty texts hold none.

    Repeated rows are all returned. Several kinds may span the same characters; each is reported.
    An empty table gives no rows.
    """
    rows, found = spans(docs.select("doc_id", "text"))
    names = F.array(*(F.lit(r.kind) for r in RULES))
    items = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    per_key = found.groupBy("key").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)), items.alias("items")
    )
    joined = lambda array: F.array_join(
        F.transform(array, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter(F.col("items"), lambda x: x["kind"] < len(BASE))
    lists = per_key.select("key", *(f"n_{r.kind}" for r in BASE), joined(base).alias("base"), joined(F.col("items")).alias("spans"))
    return rows.join(lists, "key", "left").select(
        "doc_id",
        *(F.coalesce(F.col(f"n_{r.kind}"), F.lit(0).cast("bigint")).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The documents with every secret replaced by ``mask``; spans that overlap get one mask.

    Other texts are unchanged; ``n_chars``, where there is one, follows a changed text.
    """
    _, found = spans(docs.select("doc_id", "text"))
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = found.withColumn("done", F.coalesce(F.max("end").over(before), F.lit(0)))
    cuts = cuts.groupBy(F.col("key").alias("__llm_own")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "done"))).alias("__llm_cuts"), F.max("end").alias("__llm_last")
    )
    plain = F.coalesce("text", F.lit(""))
    # Under a name of its own: inside a lambda ``text`` would mean the new column.
    keyed = docs.withColumns({"__llm_key": F.xxhash64("doc_id", plain), "__llm_text": F.col("text")})
    both = keyed.join(cuts, F.col("__llm_key") == F.col("__llm_own"), "left")
    text = F.col("__llm_text")
    part = lambda c: F.concat(
        text.substr((c["done"] + 1).cast("int"), F.greatest(c["start"] - c["done"], F.lit(0)).cast("int")),
        F.when(c["start"] >= c["done"], mask).otherwise(""),
    )
    masked = F.concat(
        F.array_join(F.transform("__llm_cuts", part), ""), text.substr((F.col("__llm_last") + 1).cast("int"), F.length(text))
    )
    changed = {"text": F.when(F.col("__llm_cuts").isNull(), text).otherwise(masked)}
    if "n_chars" in docs.columns:
        size = F.length(masked).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("__llm_cuts").isNull(), F.col("n_chars")).otherwise(size)
    return both.select(*(changed.get(n, F.col(f"`{n}`")).alias(n) for n in docs.columns))
