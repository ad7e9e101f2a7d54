"""Fill-in-the-middle: documents rearranged so that a model learns to write what is missing.

A text is cut at token borders into prefix, middle and suffix. Borders are found on its UTF-8 bytes;
cuts are wanted in code points. Only characters of more than one byte make the two differ, so an
index records just those: where they begin, and how many bytes more than characters lie before them.
A cut is converted by one binary search in it; between two of them positions differ by a constant.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
PLAIN_FROM = 90  # of 100; the rest stays plain
SPM_BELOW = 20  # of 100 that are rearranged: suffix first


class Exceptions:
    """Characters of several bytes in UTF-8 ``data``, and conversion of positions both ways.

    ``at_bytes`` and ``at_points`` are where they begin; ``excess[k]`` is how many bytes the first k
    of them take beyond one each. Memory grows with these characters, not with the text.
    """

    def __init__(self, data: np.ndarray):
        odd = np.flatnonzero(data >= 0xC0)
        lead = data[odd]
        extra = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.excess = np.concatenate([[0], np.cumsum(extra)])
        self.at_bytes = odd
        self.at_points = odd - self.excess[:-1]

    def points(self, at):
        """Code points before the characters that begin at these bytes."""
        return at - self.excess[np.searchsorted(self.at_bytes, at)]

    def bytes(self, at):
        """Bytes before the characters with these numbers."""
        return at + self.excess[np.searchsorted(self.at_points, at)]


def token_starts(data: np.ndarray) -> np.ndarray:
    """Bytes at which the tokens begin: runs of A-Z and a-z, and any other character alone."""
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80)
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def _texts(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each text of a column without NULLs, as views."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def rearranged(text: Column, draws: Column, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> Column:
    """(n, form, prefix_chars, middle_chars, output) of each text; ``draws`` holds four whole numbers."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def one(data: np.ndarray, draw: np.ndarray) -> tuple:
        starts = token_starts(data)
        n = len(starts)
        raw = data.tobytes()
        if not n or draw[2] % 100 >= plain_from or any(m in raw for m in marks):
            return n, "plain", None, None, raw
        ends = np.append(starts, len(data))
        low, high = ends[np.sort(draw[:2] % (n + 1))]
        prefix_chars, both = Exceptions(data).points(np.array([low, high]))
        prefix, middle, suffix = raw[:low], raw[low:high], raw[high:]
        if draw[3] % 100 < spm_below:
            form, output = "spm", b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle])
        else:
            form, output = "psm", b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle])
        return n, form, int(prefix_chars), int(both - prefix_chars), output

    @F.arrow_udf("struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: binary>")
    def rearrange(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        rows = [one(data, draw) for data, draw in zip(_texts(texts), values)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        return pa.StructArray.from_arrays(columns, ["n", "form", "prefix_chars", "middle_chars", "output"])

    return rearrange(F.coalesce(text, F.lit("")), draws)


def draws_of(doc_id: Column, seed: str = SEED) -> Column:
    """Four whole numbers below 2^32 per id: the first digits of a hash of the seed and the id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint") for k in range(4)])


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from. A text with a mark in it stays plain, so marks part exactly."""
    parts = F.split(output, "<[PSM]>")
    place = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    joined = {f: F.concat(*[F.get(parts, F.lit(k)) for k in order]) for f, order in place.items()}
    return F.when(form == "psm", joined["psm"]).when(form == "spm", joined["spm"]).otherwise(output)


def fill_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every text; a NULL text is empty.

    Empty texts and texts that hold a mark stay plain. A NULL id draws as an empty one; rows that
    repeat an id draw alike. Nothing is shuffled.
    """
    # A frame's own column names may clash, so both inputs are renamed first.
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    made = rows.select("doc_id", rearranged(F.col("t"), draws_of(F.col("doc_id"))).alias("m"))
    output = F.col("m.output").cast("string").alias("output")
    return made.select("doc_id", "m.n", "m.form", "m.prefix_chars", "m.middle_chars", output)


def op13(docs: DataFrame) -> DataFrame:
    """Every document cut and rearranged, with hashes of what is written and of what it restores to.

    Defined for odd rows as ``fill_middle`` says: NULL and empty texts are plain with n = 0.
    """
    made = fill_middle(docs)
    whole = restored(F.col("form"), F.col("output"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(whole.cast("binary"), 256).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (
    SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u,
           CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
           CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM d
),
c AS (
    SELECT doc_id, t, u, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM k
),
s AS (
    SELECT doc_id, t, n, form, CASE WHEN a > 0 THEN array_to_string(u[1:a], '') ELSE '' END AS p,
           CASE WHEN b > a THEN array_to_string(u[a + 1:b], '') ELSE '' END AS m, CASE WHEN n > b THEN array_to_string(u[b + 1:n], '') ELSE '' END AS f
    FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE p || m || f END) AS restored_sha256
FROM s"""
