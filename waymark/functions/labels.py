"""Display labels for numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def significant(value, digits: int = 2) -> Column:
    """Half-even rounding to a number of significant digits."""
    v = _col(value).cast("double")
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.bround(v * scale) / scale)


def plain_number(value) -> Column:
    """Number as text without exponent or trailing zeros."""
    text = _col(value).cast("decimal(30,10)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def percent_label(value, digits: int = 0) -> Column:
    return F.concat(plain_number(F.bround(_col(value) * 100, digits)), F.lit("%"))


def unit_label(value, largest, digits: int = 2) -> Column:
    """Scale by the unit of the largest value (K or M); only the largest label carries the unit."""
    v, top = _col(value), _col(largest)
    divisor = F.when(top >= 1e6, 1e6).when(top >= 1e3, 1e3).otherwise(1.0)
    unit = F.when(top >= 1e6, "M").when(top >= 1e3, "K").otherwise("")
    return F.concat(plain_number(significant(v / divisor, digits)), F.when(v == top, unit).otherwise(""))
