"""Quality scores from a sparse rule ensemble that is compiled into Spark columns.

Statistics of a text are taken in one pass. Shallow trees over them are cut into their paths; each
path is a conjunctive rule; a lasso logistic fit weighs the rules and drops most. The rest becomes
one Spark expression over the statistics. Trees and weights are fitted by Spark MLlib on about
``SAMPLE`` labelled rows, chosen by a hash of the id.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import LOWER, remainder, stored, utf8

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 20_000  # labelled rows that trees and weights are fitted on, about
TREES = 24
TREE_DEPTH = 3
LASSO = 0.002
STATISTICS = (
    "log_bytes log_words word_bytes upper digits blanks lines punctuation marks bars exclaims symbols"
    " wide unique_words top_word repeated_next unique_lines unique_pairs squeezed sentence_words"
).split()


def _share(counts: np.ndarray, chars: bytes) -> float:
    return float(counts[list(chars)].sum())


def statistics(text: bytes) -> list[float]:
    """The values of ``STATISTICS``; all zero for an empty text."""
    if not text:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    size = len(text)
    letters = float(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()) or 1.0
    words = text.translate(LOWER).split()
    n = len(words) or 1
    seen = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = sum(map(bytes.__eq__, words[1:], words))
    pairs = len(set(zip(words, words[1:])))
    stops = _share(counts, b".?")
    return [
        math.log1p(size),
        math.log1p(len(words)),
        sum(map(len, words)) / n,
        float(counts[65:91].sum()) / letters,
        _share(counts, b"0123456789") / size,
        _share(counts, b" \t\r\n\x0b\x0c") / size,
        len(lines) / n,
        _share(counts, b".,;:'\"()-") / n,
        _share(counts, b"#$%&*@^~=+<>") / n,
        _share(counts, b"|\\/_") / n,
        _share(counts, b"!") / n,
        _share(counts, b"[]{}`") / n,
        float(counts[128:].sum()) / size,
        len(seen) / n,
        max(seen.values(), default=0) / n,
        repeated / n,
        len(set(lines)) / (len(lines) or 1),
        pairs / n,
        len(zlib.compress(text, 1)) / size,
        n / (stops + 1),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (its columns but text) with a column per statistic."""
    rest = [f for f in docs.schema.fields if f.name != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(t.as_py()) for t in batch.column(0)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], *(pa.array(c) for c in values.T.copy())], [*batch.schema.names[1:], *STATISTICS]
            )

    columns = [utf8(F.col("text")).alias("text"), *(f"`{f.name}`" for f in rest)]
    own = ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(*columns).mapInArrow(measure, f"{kinds}, {own}")


Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most?, threshold), all of them


def _paths(node, names: list[str], path: Rule = ()) -> Iterator[Rule]:
    """The path to every node below the root of a fitted tree."""
    if path:
        yield path
    if node.numDescendants() == 0:
        return
    split = node.split()
    name, threshold = names[split.featureIndex()], float(split.threshold())
    yield from _paths(node.leftChild(), names, (*path, (name, True, threshold)))
    yield from _paths(node.rightChild(), names, (*path, (name, False, threshold)))


def _tidy(rule: Rule) -> Rule:
    """One condition per statistic and side, in a fixed order."""
    tightest: dict[tuple[str, bool], float] = {}
    for name, at_most, threshold in rule:
        old = tightest.get((name, at_most), threshold)
        tightest[name, at_most] = min(old, threshold) if at_most else max(old, threshold)
    return tuple(sorted((n, a, t) for (n, a), t in tightest.items()))


def holds(rule: Rule) -> Column:
    condition = F.lit(True)
    for name, at_most, threshold in rule:
        condition = condition & (F.col(name) <= threshold if at_most else F.col(name) > threshold)
    return condition


@dataclass
class RuleEnsemble:
    """Weighted rules; the score is the logistic of their sum."""

    base: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, label: str, trees: int = TREES, depth: int = TREE_DEPTH, lasso: float = LASSO) -> RuleEnsemble:
    """Learns from rows of statistics with a 0/1 ``label``.

    With labels of one kind only, or none, the score is the smoothed share of ones for all texts.
    """
    seen = rows.agg(F.count(label).alias("n"), F.coalesce(F.sum(label), F.lit(0)).alias("ones")).first()
    n, ones = int(seen["n"]), int(seen["ones"])
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    vectors = rows.select(F.col(label).cast("double").alias("label"), *STATISTICS, array_to_vector(F.array(*STATISTICS)).alias("features"))
    # Both classes count the same while the trees are grown, so that rare ones get rules too.
    balanced = vectors.withColumn("weight", F.when(F.col("label") > 0, n / (2 * ones)).otherwise(n / (2 * (n - ones))))
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5, seed=7, weightCol="weight"
    ).fit(balanced)
    rules = sorted({_tidy(rule) for tree in forest.trees for rule in _paths(tree._java_obj.rootNode(), STATISTICS)})
    if not rules:
        return RuleEnsemble(math.log(ones / (n - ones)), [])
    marks = F.array(*(holds(rule).cast("double") for rule in rules))
    fitted = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(
        vectors.select("label", array_to_vector(marks).alias("features"))
    )
    weights = [float(w) for w in fitted.coefficients]
    return RuleEnsemble(float(fitted.intercept), [(r, w) for r, w in zip(rules, weights) if w])


def op1(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; ids with remainder 1 of 3 are held out.

    NULL and empty texts have statistics of zero and a score like any other. Several labels of an id
    count as their mean, rounded up at a half; NULL labels and ids teach nothing; a NULL id is not
    held out. Repeated rows stay repeated. Without labels every score is 0.5.
    """
    part = remainder(F.col("doc_id"), 3)
    held = F.coalesce(part == 1, F.lit(False))
    table = stored(measured(docs.select("doc_id", held.alias("held_out"), "text")))
    judged = (
        labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    known = table.filter(~F.col("held_out")).join(judged, "doc_id")
    place = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1_000_003)) / 1_000_003
    share = min(1.0, sample / max(1, known.count()))
    model = fit(stored(known.filter(place < share)), "label")
    return table.select("doc_id", "held_out", model.score().alias("score")).select(
        "*", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
