"""Exact token counts at every prefix of a text, for a byte-level BPE vocabulary.

In BPE a sequence of tokens is the encoding of its text exactly if each two neighbours are the
encoding of theirs. So the encoding of a prefix ends in the one token that suits the encoding of
what lies before it, and one pass over a piece gives the count of all its prefixes: the count at a
position is one more than the count where its last token begins. Pieces are those of the
vocabulary's own splitting pattern and recur, so each distinct piece is worked out once per worker;
a text's counts are its pieces' counts, shifted by the counts before them.

Truncation to a budget and the cost of any prefix are then read off; nothing is encoded again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
PIECES = 400_000  # distinct pieces a worker remembers; beyond that it starts anew
SHORT = 64  # code points of the longest piece it remembers
PAIRS = 400_000  # the same for pairs of tokens
NEVER = 1 << 30  # the rank of no merge

# Fixed values of the byte-level splitting rule.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())


def byte_names() -> dict[str, str]:
    """The character that stands for each byte in a byte-level vocabulary, to the byte as Latin-1.

    Printable characters stand for themselves, the other bytes for those from U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): chr(b) for b in plain} | {chr(0x100 + k): chr(b) for k, b in enumerate(rest)}


def settled_characters() -> str:
    """A class of the characters that Unicode had in version 3.2: every library knows what they are."""
    known, spans = unicodedata.ucd_3_2_0, []
    for c in range(0x80, 0x110000):
        if known.category(chr(c)) != "Cn":
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "\x00-\x7f" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


class Tables(dict):
    """Tables of pieces, worked out when first asked for; those of short pieces are kept."""

    def __init__(self, counter: PrefixCounter):
        self.counter = counter

    def __missing__(self, piece: str) -> bytes:
        found = self.counter.table(piece)
        if len(piece) <= SHORT:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = found
        return found


class PrefixCounter:
    """Counts of one vocabulary, which is the content of a byte-level BPE file of ``tokenizers``."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE vocabulary")
        special = spec.get("added_tokens") or []
        own = {a["content"] for a in special}
        if any(a.get(k) for a in special for k in ("single_word", "lstrip", "rstrip")) or any(a != b and a in b for a in own for b in own):
            raise ValueError("special strings that take in what surrounds them, or each other, are not supported")
        names = byte_names()

        def plain(token: str) -> str:
            return "".join(names[c] for c in token)

        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(plain(a), plain(b)): k for k, (a, b) in enumerate(pairs)}
        self.parts = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        if len(self.parts) < len(self.rank):
            raise ValueError("two merges make the same token")
        self.automaton = ahocorasick.Automaton()
        for token in model["vocab"]:
            if token not in own:
                self.automaton.add_word(plain(token), plain(token))
        self.automaton.make_automaton()
        self.special = re.compile("|".join(map(re.escape, sorted(own)))) if own else None
        self.split = regex.compile(SPLIT)
        self.unsettled = re.compile(f"[^{settled_characters()}]")
        self.library = content
        self.tables = Tables(self)
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: dict[tuple[str, bool], list[tuple[str, int]]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain BPE: the pair of the lowest rank is merged, the leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, NEVER) for p in zip(parts, parts[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == NEVER:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def edge(self, token: str, right: bool) -> list[tuple[str, int]]:
        """What stands at an end of a token while it is merged, and the rank of the merge that takes it in."""
        found = self.edges.get((token, right))
        if found is None:
            found, part, rank = [], token, NEVER
            while True:
                found.append((part, rank))
                if part not in self.parts:
                    break
                a, b, rank = self.parts[part]
                part = b if right else a
            found.reverse()
            self.edges[token, right] = found
        return found

    def suits(self, before: str, token: str) -> bool:
        """Are the two the encoding of their text? With nothing before: is the token that of its own?

        A pair that holds a token ranks after the merge that made it, so merges happen by rising rank,
        in both tokens as if each were alone, until one of what meets at the border comes first.
        """
        if not before:
            return self.merged(token) == [token]
        left, right = self.edge(before, True), self.edge(token, False)
        i = j = 0
        while True:
            (x, x_goes), (y, y_goes) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            # Of equal ranks the leftmost goes first.
            if rank < x_goes and rank <= y_goes and rank < NEVER:
                return False
            if x_goes == y_goes == NEVER:
                return True
            if x_goes <= y_goes:
                i += 1
            else:
                j += 1

    def unit_counts(self, data: str) -> list[int]:
        """Tokens of each prefix of a text that is one piece, given as Latin-1 of its bytes."""
        last, count, fits = [""] + [None] * len(data), [0] * (len(data) + 1), self.fits
        for end, token in self.automaton.iter(data):
            end += 1
            if last[end] is None:
                start = end - len(token)
                pair = last[start], token
                known = fits.get(pair)
                if known is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    known = fits[pair] = self.suits(*pair)
                if known:
                    last[end], count[end] = token, count[start] + 1
        return count

    def table(self, piece: str) -> bytes:
        """Tokens of each prefix of a piece, a 32-bit number per code point."""
        if piece in CONTRACTIONS:  # its prefixes are split otherwise
            counts = [sum(self.unit_counts(q)[-1] for q in self.split.findall(piece[:k])) for k in range(1, len(piece) + 1)]
            return array("i", counts).tobytes()
        if piece.isascii():
            return array("i", self.unit_counts(piece)[1:]).tobytes()
        data = piece.encode("utf-8", "replace")
        counts = self.unit_counts(data.decode("latin-1"))
        ends = accumulate(len(c.encode("utf-8", "replace")) for c in piece)
        return array("i", [counts[e] for e in ends]).tobytes()

    def pieces(self, text: str) -> list[str]:
        """The text split by the vocabulary's pattern, as the library splits it."""
        if text.isascii() or not self.unsettled.search(text):
            return self.split.findall(text)
        if isinstance(self.library, str):
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.library).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def plain_counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text without special strings."""
        tables = list(map(self.tables.__getitem__, self.pieces(text)))
        counts = np.frombuffer(b"".join(tables), np.int32)
        if not len(counts):
            return counts
        ends = np.cumsum(np.fromiter(map(len, tables), np.int64, len(tables))) // 4
        totals = np.cumsum(counts[ends - 1])
        before = (totals - counts[ends - 1]).astype(np.int32)
        out = counts + np.repeat(before, np.diff(ends, prepend=0))
        # White space before a word is split, but is one piece of the prefix that ends in it.
        for run in RUNS.finditer(text):
            a, b = run.span()
            out[b - 1] = (out[a - 1] if a else 0) + np.frombuffer(self.tables[run[0]], np.int32)[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text: element k is the count of its first k + 1 code points."""
        if not self.special or not (found := [m.span() for m in self.special.finditer(text)]):
            return self.plain_counts(text)
        out, base, at = [], 0, 0
        for start, end in found:
            # Up to its last character a special string is ordinary text.
            part = self.plain_counts(text[at : end - 1]) + base
            out += [part, [(int(part[start - at - 1]) if start > at else base) + 1]]
            base, at = int(out[-1][0]), end
        return np.concatenate([*out, self.plain_counts(text[at:]) + base]).astype(np.int32)


# Two or more white spaces before something else.
RUNS = regex.compile(r"\s{2,}(?=\S)")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabulary of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_vocabulary(spark: SparkSession, path: str):
    """The file, read by the driver and sent to each worker once: its size is that of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast({"content": file.read()})


def counter_of(shared) -> PrefixCounter:
    """The worker's counter; the broadcast value outlives a task, and so does what it holds."""
    held = shared.value
    if "counter" not in held:
        held["counter"] = PrefixCounter(held["content"])
    return held["counter"]


def prefix_counts(docs: DataFrame, text: str = "text", path: str | None = None, column: str = "prefix_tokens") -> DataFrame:
    """``docs`` with an array of the token counts of every prefix: element k for the first k + 1 code points.

    A NULL or empty text has an empty array. A column of that name is replaced. Store the result
    and use ``tokens_before``, ``longest_within`` for any cut or budget.
    """
    shared = shared_vocabulary(docs.sparkSession, path or vocabulary_path())

    @F.arrow_udf("array<int>")
    def all_counts(texts: pa.Array) -> pa.Array:
        counter = counter_of(shared)
        found = [counter.counts(t.as_py()) for t in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *found])))

    return docs.withColumn(column, all_counts(F.coalesce(F.col(text), F.lit(""))))


def tokens_before(counts, chars):
    """Tokens of the first ``chars`` code points, from the array of prefix counts; all of them beyond its end."""
    at = F.least(chars, F.size(counts))
    return F.when(at > 0, F.get(counts, at.cast("int") - 1)).otherwise(0)


def longest_within(counts, budget):
    """Code points of the longest prefix of at most ``budget`` tokens.

    Counts may fall as a prefix grows, so the last position within the budget decides.
    """
    fits = F.transform(counts, lambda c, i: F.when(c <= budget, i + 1).otherwise(0))
    return F.coalesce(F.array_max(fits), F.lit(0))


def count_tokens(docs: DataFrame, text: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``docs`` with n_tokens and limit_chars, the code points of the longest prefix within the limit.

    Both are read off the counts of all prefixes; these do not leave the worker.
    """
    shared = shared_vocabulary(docs.sparkSession, path or vocabulary_path())

    @F.arrow_udf("struct<n_tokens: bigint, limit_chars: bigint>")
    def totals(texts: pa.Array) -> pa.Array:
        counter = counter_of(shared)
        whole, within = [], []
        for t in texts:
            counts = counter.counts(t.as_py())
            fits = np.flatnonzero(counts <= limit)
            whole.append(int(counts[-1]) if len(counts) else 0)
            within.append(int(fits[-1]) + 1 if len(fits) else 0)
        return pa.StructArray.from_arrays([pa.array(whole, pa.int64()), pa.array(within, pa.int64())], ["n_tokens", "limit_chars"])

    counted = docs.withColumn("_counts", totals(F.coalesce(F.col(text), F.lit(""))))
    kept = [f"`{c}`" for c in docs.columns if c not in ("n_tokens", "limit_chars")]
    return counted.select(*kept, "_counts.n_tokens", "_counts.limit_chars")


def op12(docs: DataFrame) -> DataFrame:
    """Bytes and tokens of every document, whether it is over 1024 tokens, and how much of it is within.

    A NULL or empty text has no bytes and no tokens. Special strings in a text are one token each.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = count_tokens(rows)
    return counted.select(
        "doc_id",
        F.octet_length("text").cast(T.LongType()).alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
        "limit_chars",
    )
