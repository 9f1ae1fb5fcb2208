"""Numeric cleaning and arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that stand for a suppressed count.
SUPPRESSION_MARKS = ["X", "x", "D", "-"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(text) -> Column:
    """First number inside a text, thousands commas removed; null when there is none."""
    found = F.regexp_extract(_col(text), r"(-?\d[\d,]*\.?\d*)", 1)
    return F.nullif(F.replace(found, F.lit(",")), F.lit("")).try_cast("double")


def amount(text) -> Column:
    """Number of a whole cell as landed sheets write it: currency signs, thousands separators, a sign, decimals.

    Brackets around the number make it negative, as in accounts. A cell with anything else in it gives null.
    """
    c = F.regexp_replace(_col(text), r"[\s\p{Sc}]", "")
    inner = F.regexp_replace(c, r"^\((.*)\)$", "-$1")
    whole = F.when(inner.rlike(r"^[-+]?(\d+|\d{1,3}(,\d{3})+|\d+(,\d+)+)(\.\d*)?$|^[-+]?\.\d+$"), F.replace(inner, F.lit(",")))
    return whole.try_cast("double")


def digits_only(text) -> Column:
    """Number of a cell after all punctuation and blanks are removed; blank gives null.

    For whole counts only: a cell with a decimal part or a leading sign would change its value, and gives null.
    """
    bare = F.regexp_replace(_col(text), r"[\p{Punct}\s]+", "")
    spoiled = _col(text).rlike(r"\d\.\d{1,2}(\D|$)|\d\.\d{4,}|^\s*[-+]\s*\d")
    return F.when(~spoiled, F.nullif(bare, F.lit(""))).try_cast("bigint")


def unsuppress(text, marks=SUPPRESSION_MARKS) -> Column:
    """Number of a cell, null where the cell only holds a suppression mark."""
    c = F.trim(_col(text))
    return F.when(c.isin(list(marks)), None).otherwise(parse_number(c))


def zero_to_null(value) -> Column:
    """Null for 0 and for infinities, which reports show as an empty cell."""
    v = _col(value).cast("double")
    return F.when((v == 0) | (F.abs(v) == float("inf")) | F.isnan(v), None).otherwise(v)


def ratio(numerator, denominator) -> Column:
    """Division that gives null for a zero base."""
    return F.try_divide(_col(numerator), _col(denominator))


def change(new, old) -> Column:
    """Relative change ``new / old - 1``."""
    return ratio(_col(new) - _col(old), old)


def signed_root(value, degree: int = 3) -> Column:
    v = _col(value)
    return F.signum(v) * F.pow(F.abs(v), F.lit(1.0 / degree))


def mirror(value, when: Column) -> Column:
    """Negative on one side of a pyramid."""
    return F.when(when, -_col(value)).otherwise(_col(value))


def compound_growth(first, last, periods) -> Column:
    """Compound growth rate per period; null for a zero base."""
    return F.pow(ratio(last, first), F.lit(1.0) / _col(periods)) - 1


def strict_sum(value) -> Column:
    """Sum that is null as soon as one input is null."""
    v = _col(value)
    return F.when(F.count(v) == F.count(F.lit(1)), F.sum(v))


def sum_where(value, condition: Column) -> Column:
    """Sum over the rows that meet a condition, 0 when there are none."""
    return F.coalesce(F.sum(F.when(condition, _col(value))), F.lit(0))


def mean_where(value, condition: Column) -> Column:
    """Mean over the rows that meet a condition, null when there are none."""
    return F.avg(F.when(condition, _col(value)))


def value_at(value, condition: Column) -> Column:
    """The one value of a group that meets a condition."""
    return F.max(F.when(condition, _col(value)))
