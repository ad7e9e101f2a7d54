"""Lookup joins that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webcorpus.session import cut_lineage

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 64
HOT_ROWS = 1_000_000


def _width(field: T.StructField) -> Column:
    """Bytes a value takes, about."""
    value, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        return F.octet_length(value) + 8
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.size(value) * 8 + 8
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.octet_length(F.to_json(F.struct(value))) + 8
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``, counted by a job (not estimated by the planner)."""
    row = reduce(add, (F.coalesce(_width(f), F.lit(8)) for f in df.schema.fields))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()["bytes"]


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with at least ``hot_rows`` rows; of n rows these are at most n / ``hot_rows``.

    Rows are counted per key before they are shuffled. The result is written down once, so every
    use of it sees the same keys.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    hot = counts.filter(F.col("_rows") >= hot_rows)
    return cut_lineage(hot.select(*keys, F.lit(True).alias("_hot")))


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    spread_by: str | list[str] | None = None,
    settle: bool = False,
    max_broadcast: int | None = None,
    hot_rows: int | None = None,
    hot: Callable[[], DataFrame] | None = None,
) -> DataFrame:
    """Join ``left`` to a lookup that is unique on ``on``.

    A lookup whose counted size is within ``max_broadcast`` is broadcast, so ``left`` does not
    move. A larger one is joined by shuffle; keys that hold very many rows of ``left`` are then
    split over ``SALTS`` tasks by ``spread_by`` (columns that differ between rows of one key),
    and only the lookup rows of those keys are copied. ``settle`` writes the lookup to the
    checkpoint folder first, for one that is costly to compute twice (to count and to join).
    ``hot`` gives the frequent keys of ``left`` where a caller joins the same rows repeatedly.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if settle:
        lookup = cut_lineage(lookup)
    if measured_bytes(lookup) <= (BROADCAST_BYTES if max_broadcast is None else max_broadcast):
        return left.join(F.broadcast(lookup), keys, how)
    frequent = hot() if hot else hot_keys(left, keys, HOT_ROWS if hot_rows is None else hot_rows)
    if frequent.isEmpty():
        return left.join(lookup, keys, how)
    spread = [spread_by] if isinstance(spread_by, str) else list(spread_by or left.columns)
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    # Rows without a key match nothing, wherever they are.
    spread_out = F.col("_hot") | reduce(or_, (F.col(k).isNull() for k in keys))
    salted = left.join(F.broadcast(frequent), keys, "left").withColumn(
        "_salt", F.when(spread_out, salt).otherwise(0)
    )
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    copies = lookup.join(F.broadcast(frequent), keys, "left").withColumn("_salt", F.explode(every))
    return salted.drop("_hot").join(copies.drop("_hot"), [*keys, "_salt"], how).drop("_salt")
