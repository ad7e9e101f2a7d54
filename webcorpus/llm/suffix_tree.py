"""Language-model scores from a probabilistic suffix tree over bytes, and a word unigram base.

The symbols are the UTF-8 bytes of a text's words, A-Z lower-cased, joined by one space, and an end
symbol. A context of up to ``depth`` symbols is a candidate if it occurs ``least`` times, so the model
grows with the corpus. A candidate is retained if its next symbols diverge from its parent's (the
context without its first symbol) by more than their number explains. Next-symbol distributions are
smoothed by the parent's, down to the uniform one, so every text has a positive probability. The
contexts stay in tables, one per length. A text is scored by its windows of depth + 1 symbols: a
broadcast head of bounded size has the most frequent ones, the others are joined by shuffle.
"""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webcorpus.llm.common import LOWER, remainder, stored, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = 0x0A  # never inside a word; also stands before the first symbol
SYMBOLS = 256
DEPTH = 5  # at most 6: a window is packed in 64 bits
LEAST = 2  # occurrences that a candidate context needs; under 1: their share of all positions
GAIN = 1.0  # nats of divergence per seen next symbol that retain a context
BACK_OFF = 10.0  # weight of the parent's distribution, in counts
HEAD = 100_000  # words whose counts are broadcast at most: the most frequent ones
HEAD_WINDOWS = 1_000_000  # windows whose probabilities are broadcast at most: the most frequent ones
HEAD_BYTES = 64  # longer words are never in the head
FLUSH = 300_000  # distinct words a task holds before it passes them on
CHUNK = 512  # symbols walked in a row; chunks are walked side by side


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of padded texts, one after the other, where each starts, and its length."""
    pad, end = bytes([END]) * depth, bytes([END])
    parts = [pad + t + end for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
    return codes[first], np.add.reduceat(counts, first)


def _windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of depth + 1 symbols, packed big-endian, that end in a real symbol, and their texts."""
    symbols, starts, sizes = _stream(texts, depth)
    codes = np.zeros(max(0, len(symbols) - depth), np.int64)
    for k in range(depth + 1 if len(codes) else 0):
        codes = (codes << 8) | symbols[k : len(symbols) - depth + k]
    real = np.ones(len(symbols), bool)
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return codes[real[depth:]], np.repeat(np.arange(len(texts)), sizes - depth)


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and their counts."""
    return np.unique(_windows(texts, depth)[0], return_counts=True)


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(word, gram, n): counts of words (the end counts as the empty word) and of symbol windows.

    One pass over the texts. A task hands its counts on whenever it holds ``FLUSH`` words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def out(words: list[bytes], ns: list[int]) -> pa.RecordBatch:
            none = pa.nulls(len(words), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), none, pa.array(ns, pa.int64())], ["word", "gram", "n"])

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at in range(0, len(texts), 500):
                split = [words_of(t) for t in texts[at : at + 500]]
                for words in split:
                    held.update(words)
                held[b""] += len(split)
                if len(held) >= FLUSH:
                    yield out(list(held), list(held.values()))
                    held.clear()
                grams.append(_grams([b" ".join(w) for w in split], depth))
                if sum(len(g) for g, _ in grams) > 1_500_000:
                    grams = [_merged(*(np.concatenate(x) for x in zip(*grams)))]
                    if len(grams[0][0]) > 1_000_000:
                        yield from _gram_rows(*grams.pop())
        if held:
            yield out(list(held), list(held.values()))
        if grams:
            yield from _gram_rows(*_merged(*(np.concatenate(x) for x in zip(*grams))))

    partial = docs.select(utf8(F.col("text")).alias("text")).mapInArrow(count, "word binary, gram bigint, n bigint")
    return partial.groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _gram_rows(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(codes), 100_000):
        part = codes[at : at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(counts[at : at + 100_000])], ["word", "gram", "n"]
        )


def candidates(counts: DataFrame, depth: int = DEPTH, least: float = LEAST) -> DataFrame:
    """(level, context, symbol, n, total) of the contexts that occur often enough to be learned."""
    grams = counts.filter("gram IS NOT NULL")
    if least < 1:
        least *= grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    edges = (
        grams.select("gram", "n", levels.alias("level"))
        .select(
            "level",
            F.expr("shiftright(gram, 8) & (shiftleft(1L, 8 * level) - 1)").alias("context"),
            F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("symbol"),
            "n",
        )
        .groupBy("level", "context", "symbol")
        .agg(F.sum("n").alias("n"))
    )
    # A window of the function holds the next symbols of one context, at most 256 rows.
    total = F.sum("n").over(Window.partitionBy("level", "context"))
    return edges.withColumn("total", total).filter(F.col("total") >= least)


def learned(counts: DataFrame, depth: int = DEPTH, least: float = LEAST, gain: float = GAIN, back_off: float = BACK_OFF) -> list[DataFrame]:
    """Per context length a stored table (context, symbol, n, p, fall) of the candidates.

    ``p`` is the smoothed probability of the symbol, ``fall`` what the parent's probability of an
    unseen symbol is multiplied by: 1 if the context is not retained. Lengths are learned in turn,
    each joined to the one before; all tables grow with the corpus and are joined by shuffle.
    """
    edges = stored(candidates(counts, depth, least))
    levels: list[DataFrame] = []
    for level in range(depth + 1):
        own = edges.filter(F.col("level") == level).drop("level")
        if level:
            above = levels[-1].select(F.col("context").alias("up"), "symbol", F.col("p").alias("parent"))
            own = own.withColumn("up", F.col("context").bitwiseAND(F.lit((1 << 8 * (level - 1)) - 1))).join(above, ["up", "symbol"])
        else:
            own = own.withColumn("parent", F.lit(1 / SYMBOLS))
        context = Window.partitionBy("context")
        nats = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("parent"))).over(context)
        own = own.withColumn("keep", nats > gain * F.count("*").over(context) if level else F.lit(True))
        weight = F.lit(back_off) / (F.col("total") + back_off)
        levels.append(
            stored(
                own.select(
                    "context",
                    "symbol",
                    "n",
                    F.when(F.col("keep"), F.col("n") / (F.col("total") + back_off) + weight * F.col("parent")).otherwise(F.col("parent")).alias("p"),
                    F.when(F.col("keep"), weight).otherwise(F.lit(1.0)).alias("fall"),
                )
            )
        )
    return levels


def chances(grams: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(gram, log) of distinct windows: the log10 probability of the last symbol after the others.

    The longest context that has seen the symbol gives its probability; each retained longer one that
    has not takes its share off.
    """
    left, found = grams.withColumn("fall", F.lit(1.0)), []
    for level in reversed(range(len(levels))):
        known = levels[level].groupBy("context").agg(
            F.first("fall").alias("own"), F.map_from_entries(F.collect_list(F.struct("symbol", "p"))).alias("chance")
        )
        context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * level) - 1))
        symbol = F.col("gram").bitwiseAND(F.lit(255)).cast("int")
        looked = stored(
            left.withColumn("context", context)
            .join(known, "context", "left")
            .select("gram", "fall", "own", F.try_element_at("chance", symbol).alias("p"))
        )
        found.append(looked.filter("p IS NOT NULL").select("gram", F.log10(F.col("fall") * F.col("p")).alias("log")))
        left = looked.filter("p IS NULL").select("gram", (F.col("fall") * F.coalesce("own", F.lit(1.0))).alias("fall"))
    every = left.select("gram", F.log10(F.col("fall") / SYMBOLS).alias("log"))
    for part in found:
        every = every.unionAll(part)
    return every


@dataclass
class Tree:
    """States with, for every symbol class, the next state and the log10 probability.

    The same model in the memory of one process, for few contexts; the tables are tested against it.
    """

    depth: int
    group: np.ndarray  # symbol -> class
    step: np.ndarray  # (states, classes) next state
    gain: np.ndarray  # (states, classes) log10 probability of a symbol of the class
    start: int

    def walk(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text and its end.

        A state depends on the last ``depth`` symbols only, so a stream is cut into chunks that are
        walked side by side, each warmed up on the symbols before it.
        """
        symbols, starts, sizes = _stream(texts, self.depth)
        classes = self.group[symbols]
        total = len(classes) - self.depth
        n = max(1, -(-total // CHUNK))
        padded = np.concatenate([classes, np.zeros(n * CHUNK - total, classes.dtype)])
        width = self.step.shape[1]
        flat_step, flat_gain = self.step.ravel(), self.gain.ravel()
        rows = np.arange(n) * CHUNK
        state = np.full(n, self.start, np.int64)
        values = np.empty((CHUNK, n))
        for k in range(self.depth + CHUNK):
            at = state * width + padded[rows + k]
            if k >= self.depth:
                values[k - self.depth] = flat_gain[at]
            state = flat_step[at].astype(np.int64)
        each = np.concatenate([np.zeros(self.depth), values.T.ravel()[:total]])
        each[(starts[:, None] + np.arange(self.depth)).ravel()] = 0.0
        return np.add.reduceat(each, starts)


def grow(edges: list[tuple[np.ndarray, ...]], depth: int = DEPTH, gain: float = GAIN, back_off: float = BACK_OFF) -> Tree:
    """The tree of the candidate edges (context, symbol, n), one triple of arrays per level."""
    whole = np.zeros(SYMBOLS)
    np.add.at(whole, edges[0][1], edges[0][2])
    usual = np.nonzero(whole >= 1)[0]
    # Unseen symbols share the last class, equally likely within it.
    group = np.full(SYMBOLS, len(usual), np.int64)
    group[usual] = np.arange(len(usual))
    width, rare = len(usual) + 1, SYMBOLS - len(usual)
    uniform = np.ones(width)
    uniform[-1] = rare
    uniform /= uniform.sum()
    known: list[np.ndarray] = []
    smooth: list[np.ndarray] = []  # per level: distributions over classes
    kept: list[np.ndarray] = []
    for level, (context, symbol, n) in enumerate(edges[: depth + 1]):
        codes, row = np.unique(context, return_inverse=True) if len(context) else (np.zeros(int(level == 0), np.int64), np.zeros(0, np.int64))
        counts = np.zeros((len(codes), width))
        np.add.at(counts, (row, group[symbol]), n)
        total = counts.sum(axis=1, keepdims=True)
        if level:
            above = np.searchsorted(known[-1], codes & ((1 << 8 * (level - 1)) - 1))
            parent = smooth[-1][above]
        else:
            parent = np.broadcast_to(uniform, counts.shape)
        own = (counts + back_off * parent) / (total + back_off)
        with np.errstate(divide="ignore", invalid="ignore"):
            nats = np.where(counts > 0, counts * np.log(counts / total / parent), 0.0).sum(axis=1)
        keep = nats > gain * np.maximum(1, (counts > 0).sum(axis=1)) if level else np.ones(len(codes), bool)
        known.append(codes)
        smooth.append(np.where(keep[:, None], own, parent))
        kept.append(keep)
    # States: retained contexts and, so that steps lose nothing, all their prefixes.
    states: list[np.ndarray] = [np.zeros(1, np.int64)]
    for level in range(1, depth + 1):
        longer = [known[j][kept[j]] >> (8 * (j - level)) for j in range(level, depth + 1)]
        states.append(np.unique(np.concatenate(longer)))
    offsets = np.cumsum([0, *(len(s) for s in states)])
    count = int(offsets[-1])
    log_p, step = np.empty((count, width), np.float32), np.zeros((count, width), np.int32)
    spread = np.ones(width)
    spread[-1] = rare
    for level, codes in enumerate(states):
        rows = slice(int(offsets[level]), int(offsets[level + 1]))
        best = np.broadcast_to(smooth[0][0], (len(codes), width)).copy()
        for j in range(1, level + 1):
            found, where = _find(known[j], codes & ((1 << 8 * j) - 1))
            best[found] = smooth[j][where]
        log_p[rows] = np.log10(best / spread)
        target = np.zeros((len(codes), width), np.int32)
        # A rare symbol is in no state but the root's, unless padding or a state holds it: none does.
        for j in range(1, min(level + 1, depth) + 1):
            after = ((codes[:, None] << 8) | usual[None, :]) & ((1 << 8 * j) - 1)
            found, where = _find(states[j], after.ravel())
            part = target[:, :-1].ravel()
            part[found] = offsets[j] + where
            target[:, :-1] = part.reshape(len(codes), len(usual))
        step[rows] = target
    start = 0
    for j in range(1, depth + 1):
        found, where = _find(states[j], np.array([int.from_bytes(bytes([END]) * j, "big")]))
        start = int(offsets[j] + where[0]) if len(found) else start
    return Tree(depth, group, step, log_p, start)


def _find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``codes`` that are present, and where in ``sorted_codes``."""
    if not len(sorted_codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    where = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    found = np.nonzero(sorted_codes[where] == codes)[0]
    return found, where[found]


def _most_frequent(rows: DataFrame, room: int) -> DataFrame | None:
    """At most ``room`` rows with the largest ``n``; None if there are none.

    Eighths of a doubling are counted first, at most 512 of them, so that no more rows are sent to
    the driver than are kept.
    """
    eighth, least = F.floor(F.log2("n") * 8), None
    for r in sorted(rows.groupBy(eighth.alias("eighth")).count().collect(), reverse=True):
        if r["count"] > room:
            break
        room, least = room - r["count"], r["eighth"]
    return None if least is None else rows.filter(eighth >= least)


def frequent_words(words: DataFrame) -> dict[bytes, int]:
    """At most ``HEAD`` of the most frequent words that are not very long, with their counts."""
    often = _most_frequent(words.filter(F.octet_length("word") <= HEAD_BYTES), HEAD)
    if often is None:
        return {}
    table = often.toArrow()
    return dict(zip(table["word"].to_pylist(), table["n"].to_pylist()))


def frequent_windows(levels: list[DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """At most ``HEAD_WINDOWS`` of the most frequent windows in order, and their log10 probabilities."""
    often = _most_frequent(levels[-1], HEAD_WINDOWS)
    if often is None:
        return np.zeros(0, np.int64), np.zeros(0)
    gram = F.shiftleft("context", 8).bitwiseOR(F.col("symbol").cast("bigint"))
    table = often.select(gram.alias("gram"), F.log10("p").alias("log")).toArrow()
    grams, logs = table["gram"].to_numpy(), table["log"].to_numpy()
    order = np.argsort(grams)
    return grams[order], logs[order]


def _head_scores(texts: list[bytes], depth: int, often: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """Sums of the known windows' log10 probabilities per text, and the other windows with counts."""
    codes, own = _windows(texts, depth)
    grams, place = np.unique(codes, return_inverse=True)
    known, at = _find(often, grams)
    logs = np.zeros(len(grams))
    logs[known] = chance[at]
    missing = np.ones(len(grams), bool)
    missing[known] = False
    score = np.bincount(own, weights=logs[place], minlength=len(texts))
    other = missing[place]
    pairs, times = np.unique(own[other] * len(grams) + place[other], return_counts=True)
    sizes = np.bincount(pairs // max(1, len(grams)), minlength=len(texts))
    values = pa.StructArray.from_arrays(
        [pa.array(grams[pairs % max(1, len(grams))], pa.int64()), pa.array(times, pa.int64())], ["gram", "n"]
    )
    return score, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values)


def scores(docs: DataFrame, counts: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """Rows of ``docs`` (doc_id, held_out, text) with n_tokens, n_known, train_tokens and both scores.

    Words and windows are looked up in broadcast heads of bounded size first; the rest, which grows
    with the corpus, is counted per row and joined by shuffle.
    """
    spark = docs.sparkSession
    words = counts.filter("word IS NOT NULL").select("word", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = frequent_words(words)
    depth = len(levels) - 1
    model = spark.sparkContext.broadcast((head, *frequent_windows(levels)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, often, chance = model.value
        logs = {w: math.log10(n + 0.1) for w, n in head.items()}
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                split = [words_of(t) for t in batch.column(3).to_pylist()]
                found, others = _head_scores([b" ".join(w) for w in split], depth, often, chance)
                sizes, known, base, rest = [], [], [], []
                for own in split:
                    value, seen, other = 0.0, 0, []
                    for word, n in Counter(own).items():
                        log = logs.get(word)
                        if log is None:
                            other.append((word, n))
                        else:
                            value += n * log
                            seen += n
                    if b"" in logs:
                        value, seen = value + logs[b""], seen + 1
                    else:
                        other.append((b"", 1))
                    sizes.append(len(own) + 1)
                    known.append(seen)
                    base.append(value)
                    rest.append(other)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, rest)]), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array([w for r in rest for w, _ in r], pa.binary()), pa.array([n for r in rest for _, n in r], pa.int64())], ["word", "n"]
                    ),
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()),
                     pa.array(base, pa.float64()), pa.array(found, pa.float64()), lists, others],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rest", "windows"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = stored(
        docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", utf8(F.col("text")).alias("text")).mapInArrow(
            score,
            f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, known bigint, logs double, score double, rest array<struct<word:binary,n:bigint>>, windows array<struct<gram:bigint,n:bigint>>",
        )
    )
    rare = rows.select("row", F.explode("rest").alias("w")).select("row", "w.word", F.col("w.n").alias("times"))
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.1))
    rare = (
        rare.join(words, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * log).alias("more_logs"),
            F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"),
        )
    )
    asked = rows.select("row", F.explode("windows").alias("w")).select("row", "w.gram", F.col("w.n").alias("times"))
    unusual = (
        asked.join(chances(stored(asked.select("gram").distinct()), levels), "gram")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
    )
    total = math.log10(sums["n"] + 0.1 * (sums["v"] + 1))
    zero = F.lit(0)
    return rows.drop("rest", "windows").join(rare, "row", "left").join(unusual, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", zero)).alias("n_known"),
        F.lit(sums["n"]).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def op4(docs: DataFrame) -> DataFrame:
    """Scores of every row; texts of ids with remainder 0 of 10 are held out of the learning.

    NULL texts are empty: one token, the end. A NULL id is neither held out nor learned from.
    Repeated rows are scored and counted each. Without a training text every symbol is equally
    likely and the base score is zero; an empty table gives no rows.
    """
    part = remainder(F.col("doc_id"), 10)
    counts = stored(corpus_counts(docs.filter(part != 0).select("text")))
    held = docs.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text")
    return scores(held, counts, learned(counts))
