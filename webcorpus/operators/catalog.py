"""Choice of the latest version from a catalogue of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a wanted name contains, must not contain, and the fallback.
WANTED, UNWANTED, DEFAULT_NAME = "flash", "pro", "gemini-1.5-flash"
PREFIX = "models/"


def name_version(name: Column) -> Column:
    """All digit groups joined by '.', read as a number as far as that goes; 0 without digits."""
    joined = F.array_join(F.regexp_extract_all(name, F.lit(r"(\d+\.?\d*)"), 1), ".")
    number = F.regexp_extract(joined, r"^(\d+(?:\.\d+)?)", 1)
    return F.coalesce(number.try_cast("double"), F.lit(0.0))


def latest_version(
    names: DataFrame, family: str, name: str, position: str, default: str = DEFAULT_NAME
) -> DataFrame:
    """(family, latest): newest wanted name of each family, the first one among equals.

    Families without a wanted name get the default. One aggregation that is combined before
    the shuffle, whatever the size of a family.
    """
    text = F.col(name)
    wanted = text.contains(WANTED) & ~text.contains(UNWANTED)
    rank = F.when(wanted, F.struct(name_version(text).alias("version"), (-F.col(position)).alias("p")))
    best = F.max_by(F.regexp_replace(text, rf"^(.*?){PREFIX}", "$1"), rank)
    return names.groupBy(family).agg(
        F.coalesce(F.when(F.count_if(wanted) > 0, best), F.lit(default)).alias("latest")
    )
