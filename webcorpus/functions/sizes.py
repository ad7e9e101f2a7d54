"""Human-readable sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: SI unit names by power of 1000.
UNITS = ["B", "kB", "MB", "GB", "TB", "PB", "EB"]
_MAX = 2**63 - 1


def _in_unit(n: Column, power: int) -> Column:
    """``n`` to three significant digits in units of 1000**power.

    Rounding looks at the double quotient, as a JavaScript number would: the double is turned
    into an exact integer (times 2**52) and compared with the half-way point in decimals.
    """
    unit = 1000**power
    exact = (n.cast("double") / F.lit(float(unit)) * F.lit(float(2**52))).cast("bigint")

    def digits(scale: int) -> Column:
        step = unit // 10**scale
        multiple = (n - n % F.lit(step)).cast("decimal(19,0)")
        low = (multiple / F.lit(step).cast("decimal(19,0)")).cast("bigint")
        half = (low.cast("decimal(19,0)") * F.lit(step).cast("decimal(19,0)")) + F.lit(
            step // 2
        ).cast("decimal(19,0)")
        up = (
            exact.cast("decimal(19,0)") * F.lit(unit).cast("decimal(19,0)")
            >= half.cast("decimal(20,0)") * F.lit(2**52).cast("decimal(16,0)")
        )
        units = low + up.cast("bigint")
        if scale == 0:
            return units.cast("string")
        value = (units.cast("decimal(12,0)") / F.lit(10**scale)).cast(f"decimal(12,{scale})")
        return F.regexp_replace(value.cast("string"), r"\.?0+$", "")

    if 10 * unit > _MAX:
        return digits(2)
    return F.when(n < 10 * unit, digits(2)).when(n < 100 * unit, digits(1)).otherwise(digits(0))


def pretty_bytes(n: Column) -> Column:
    """1337 -> '1.34 kB'; NULL stays NULL. ``n`` is a non-negative whole number."""
    n = n.cast("bigint")
    whole = F.when(n < 1000, F.concat(n.cast("string"), F.lit(" B")))
    top = len(UNITS) - 1
    return reduce(
        lambda chain, p: chain.when(
            n < 1000 ** (p + 1), F.concat(_in_unit(n, p), F.lit(" " + UNITS[p]))
        ),
        range(1, top),
        whole,
    ).otherwise(F.concat(_in_unit(n, top), F.lit(" " + UNITS[top])))
