"""Language identification by hierarchy: the family first, then its languages one against one.

Every decision is between two sides by a linear support vector machine over hashed byte n-grams.
Machines are trained side by side as Spark groups, one per pair, on a sample of about ``SAMPLE``
texts per language; the sample is chosen by a hash of the id. Whole texts are read for training
and prediction.
"""

from __future__ import annotations

import itertools
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webcorpus.llm.common import remainder, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 4096
SAMPLE = 500  # texts per language that train the machines, about
EPOCHS = 30
UNKNOWN = "und"
WORD_CHARACTER = re.compile(r"[^\W\d_]+")

# Families of ISO 639-1 codes. Any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl it la oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd gv kw",
    "uralic": "et fi hu se",
    "turkic": "az ba kk ky tk tr tt ug uz",
    "indo_aryan": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt ti",
    "iranian": "fa ku ps tg",
    "sinitic": "zh",
    "malayic": "id jv ms su",
}


def lettered(text: str) -> bool:
    """Has the text a letter, of Unicode's category L? Numerals such as a half or a square are none."""
    return any(c.isalpha() for run in WORD_CHARACTER.finditer(text) for c in run[0])


def family_of(code: str) -> str:
    return next((name for name, codes in FAMILIES.items() if code in codes.split()), f"={code}")


_BLANKS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def features(text: str) -> np.ndarray | None:
    """Unit vector of square-rooted n-gram counts (1 to 3 bytes); None without a letter."""
    if not lettered(text):
        return None
    data = b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKS).split())
    codes = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    total = np.bincount(codes, minlength=BUCKETS)
    gram = codes
    for size in (2, 3):
        gram = (gram[:-1] << np.uint32(8)) | codes[size - 1 :]
        total += np.bincount(((gram * np.uint32(2654435761)) >> np.uint32(20)), minlength=BUCKETS)
    vector = np.sqrt(total.astype(np.float64))
    return vector / np.sqrt(vector @ vector)


def train_machine(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 1e-4) -> tuple[np.ndarray, float, float]:
    """Weights, bias and slope of a linear machine; y is +1 or -1; sides weigh the same.

    Averaged stochastic subgradient steps on the hinge loss; the slope turns a margin into a chance.
    """
    order = np.random.default_rng(0)
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    w, mean, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for epoch in range(epochs):
        for i in order.permutation(len(x)):
            t += 1
            step = 1.0 / (rate * (t + 1e4))
            margin = y[i] * (x[i] @ w)
            w *= 1 - step * rate
            if margin < 1:
                w += min(step, 10.0) * weight[i] * y[i] * x[i]
        if epoch >= epochs // 2:
            mean += w
    w = mean / (epochs - epochs // 2)
    margins = y * (x @ w)
    slopes = np.geomspace(0.1, 20, 40)
    loss = [(weight * np.logaddexp(0, -s * margins)).sum() + 0.01 * s for s in slopes]
    return w[:-1], float(w[-1]), float(slopes[int(np.argmin(loss))])


@dataclass
class Identifier:
    """Machines by pair of sides; sides are families, or languages of one family."""

    languages: dict[str, list[str]]
    machines: dict[tuple[str, str], tuple[np.ndarray, float, float]] = field(default_factory=dict)

    def _best(self, sides: list[str], vector: np.ndarray) -> tuple[str, float]:
        """The side with the highest mean chance against the others; ties to the first."""
        if len(sides) == 1:
            return sides[0], 1.0
        chance = dict.fromkeys(sides, 0.0)
        for a, b in itertools.combinations(sides, 2):
            w, bias, slope = self.machines[a, b]
            p = 1 / (1 + np.exp(-np.clip(slope * (vector @ w + bias), -50, 50)))
            chance[a] += p
            chance[b] += 1 - p
        best = max(sides, key=lambda s: chance[s])
        return best, float(chance[best] / (len(sides) - 1))

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = features(text) if text and self.languages else None
        if vector is None:
            return UNKNOWN, 0.0
        family, first = self._best(sorted(self.languages), vector)
        language, second = self._best(self.languages[family], vector)
        return language, first * second


def fit(docs: DataFrame, sample: int = SAMPLE) -> Identifier:
    """Learns from (doc_id, text, lang); rows without a language or a letter teach nothing."""
    known = docs.filter("lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    # About the same number of texts of each language, the same ones whenever it runs.
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003)) / 1_000_003
    share = F.lit(1.0)
    for name, count in counts.items():
        if count > sample:
            share = F.when(F.col("lang") == name, sample / count).otherwise(share)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch.column(1).to_pylist()]
            rows = [i for i, v in enumerate(found) if v is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([found[i].astype(np.float32) for i in rows], pa.list_(pa.float32()))], ["lang", "x"]
            )

    drawn = known.filter(place < share).select("lang", "text").mapInArrow(vectors, "lang string, x array<float>")
    rows = stored(drawn)
    taught = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    model = Identifier({})
    for name in taught:
        model.languages.setdefault(family_of(name), []).append(name)
    pairs = [
        (a, b, "family") for a, b in itertools.combinations(sorted(model.languages), 2)
    ] + [(a, b, "lang") for own in model.languages.values() for a, b in itertools.combinations(own, 2)]
    if not pairs:
        return model
    belongs = {name: [] for name in taught}
    for k, (a, b, kind) in enumerate(pairs):
        for name in taught:
            side = name if kind == "lang" else family_of(name)
            if side in (a, b):
                belongs[name].append((k, 1 if side == a else -1))
    table = docs.sparkSession.createDataFrame(
        [(name, k, y) for name, own in belongs.items() for k, y in own], "lang string, pair int, y int"
    )

    def machine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        # Rows arrive in any order; training must not depend on it.
        group = group.iloc[sorted(range(len(group)), key=lambda i: group["x"].iloc[i].tobytes())]
        w, bias, slope = train_machine(np.stack(group["x"]).astype(np.float64), group["y"].to_numpy(np.float64))
        return pd.DataFrame([{"pair": key[0], "w": w, "bias": bias, "slope": slope}])

    # At most pairs x two sides x languages x sample rows; the table of pairs is one row per side.
    trained = rows.join(F.broadcast(table), "lang").groupBy("pair").applyInPandas(machine, "pair int, w array<double>, bias double, slope double")
    for row in trained.collect():
        a, b, _ = pairs[row["pair"]]
        model.machines[a, b] = (np.array(row["w"]), row["bias"], row["slope"])
    return model


def identify(model: Identifier, text: Column) -> Column:
    """struct<lang_pred, score> of a text; ``und`` with score 0 if it is NULL or has no letter."""
    held = (model.languages, model.machines)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def of(texts: pa.Array) -> pa.Array:
        own = Identifier(*held)
        found = [own.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"]
        )

    return of(text)


def op8(docs: DataFrame) -> DataFrame:
    """The predicted language of every row; ids with remainder 2 of 4 are held out.

    NULL and letterless texts are ``und``; without any labelled text all are. A NULL id is neither
    held out nor learned from. One language: always that one. Repeated rows stay repeated.
    """
    part = remainder(F.col("doc_id"), 4)
    model = fit(docs.filter(part != 2).select("doc_id", "text", "lang"))
    return docs.select(
        "doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), identify(model, F.col("text")).alias("found")
    ).select("doc_id", "held_out", "found.lang_pred", "found.score")


def has_letter(text: Column) -> Column:
    """Whether a text has a letter; false for NULL."""

    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([bool(t.is_valid and lettered(t.as_py())) for t in texts], pa.bool_())

    return of(text)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a language: NULL texts and those without any letter go. Columns are kept.

    Where no language can be learned, because no row with a letter is labelled, every text with a
    letter is kept.
    """
    model = fit(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.filter(has_letter(F.col("text")))
    return docs.filter(identify(model, F.col("text"))["lang_pred"] != UNKNOWN)
