"""Fiscal and calendar arithmetic on columns. Every date is a month start."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FISCAL_START = 10

# Three-letter month prefixes, English and Spanish, with their numbers.
MONTH_PREFIXES = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
    "ene": 1, "abr": 4, "ago": 8, "set": 9, "dic": 12,
}

# Month names in calendar order, English and Spanish.
ENGLISH_MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
SPANISH_MONTHS = [
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year(date, start_month: int = FISCAL_START) -> Column:
    """Year in which the fiscal year holding ``date`` ends (October start by default)."""
    d = _col(date)
    return (F.year(d) + F.when(F.month(d) >= start_month, 1).otherwise(0)).cast("int")


def period_year(date, basis: str = "calendar") -> Column:
    """Calendar or fiscal year of a date: the one switch that every yearly report takes."""
    if basis not in ("calendar", "fiscal"):
        raise ValueError(f"basis must be calendar or fiscal, not {basis!r}")
    return fiscal_year(date) if basis == "fiscal" else F.year(_col(date))


def calendar_year(fiscal, month_number, start_month: int = FISCAL_START) -> Column:
    """Calendar year of a month that is labelled with its fiscal year."""
    fy = _col(fiscal).cast("int")
    return F.when(_col(month_number) >= start_month, fy - 1).otherwise(fy)


def fiscal_month_order(month_number, start_month: int = FISCAL_START) -> Column:
    """Sort key of months inside a fiscal year: October -2 ... December 0, January 1 ... September 9."""
    m = _col(month_number)
    return F.when(m >= start_month, m - 12).otherwise(m)


def month_names() -> dict[str, int]:
    """Every accepted spelling, in lower case: full names, their three letters, and usual variants."""
    names = {n.lower(): i + 1 for months in (ENGLISH_MONTHS, SPANISH_MONTHS) for i, n in enumerate(months)}
    return {**MONTH_PREFIXES, **names, "sept": 9, "setiembre": 9}


def month_number(text) -> Column:
    """Month number of an English or Spanish month name or abbreviation; null when unknown.

    A point or a year may follow (``Jan.``, ``jan22``, ``ene_2024``); any other text around the name makes it unknown.
    """
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(month_names().items())])
    bare = F.regexp_replace(F.lower(F.trim(_col(text))), r"\.?[\s._-]*(\d{2}|\d{4})?$", "")
    return F.try_element_at(lookup, bare)


def header_year(text, century: int | None = None) -> Column:
    """Year at the end of a month header (``jan22`` -> 2022, ``ene_2024`` -> 2024); null without one.

    Two digits get ``century``, or without it the century that puts them between 1969 and 2068.
    """
    n = F.nullif(F.regexp_extract(F.trim(_col(text)), r"^\D+(\d{2}|\d{4})$", 1), F.lit("")).try_cast("int")
    base = F.when(n >= 69, 1900).otherwise(2000) if century is None else F.lit(century)
    return F.when(n < 100, n + base).otherwise(n)


def month_start(year, month) -> Column:
    return F.make_date(_col(year).cast("int"), _col(month).cast("int"), F.lit(1))


def parse_month(year, text) -> Column:
    """``(2024, 'ene')`` or ``(2024, 'January')`` -> 2024-01-01."""
    return month_start(year, month_number(text))


def parse_fiscal_label(text, century: int = 2000) -> Column:
    """``'FY 19'`` -> 2019, ``'2024 (FYTD)'`` -> 2024; two-digit years get ``century``."""
    n = F.nullif(F.regexp_extract(_col(text), r"(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(n < 100, n + century).otherwise(n)


def label_year(text, century: int = 2000) -> Column:
    """The year that a label names, whatever else it says: ``2024*``, ``Fiscal Year 2024``, ``FY24 YTD``.

    The first number of four digits counts, else the first of two (with ``century``); numbers of other lengths are no
    years. Null without a year.
    """
    four = F.nullif(F.regexp_extract(_col(text), r"(?<!\d)(\d{4})(?!\d)", 1), F.lit("")).try_cast("int")
    two = F.nullif(F.regexp_extract(_col(text), r"(?<!\d)(\d{2})(?!\d)", 1), F.lit("")).try_cast("int")
    return F.coalesce(four, two + century)


def from_epoch_day(n) -> Column:
    """Ledger dates are stored as days since 1970-01-01."""
    return F.date_add(F.lit("1970-01-01").cast("date"), _col(n).cast("int"))


def date_anchors(as_of: DataFrame, date: str = "date") -> DataFrame:
    """Reporting dates that follow from the as-of month of a one-row frame."""
    d2 = F.trunc(F.col(date), "month")
    d1 = F.add_months(d2, -1)
    return as_of.select(
        d2.alias("date2"),
        F.year(d2).alias("year2"),
        F.date_format(d2, "MMM").alias("month2"),
        F.date_format(d2, "MMMM").alias("month2_long"),
        d1.alias("date1"),
        F.year(d1).alias("year1"),
        F.date_format(d1, "MMM").alias("month1"),
        F.date_format(d1, "MMMM").alias("month1_long"),
        F.add_months(d2, -36).alias("date_3_ago"),
    )


def month_spine(bounds: DataFrame, start: str, end: str, name: str = "date") -> DataFrame:
    """Every month start between two date columns of each row of ``bounds``; other columns are kept."""
    steps = F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month"))
    keep = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*keep, F.explode(steps).alias(name))


def anchored_month_steps(bounds: DataFrame, start: str, end: str, per_year: int, name: str = "date") -> DataFrame:
    """Months ``12 / per_year`` apart that include the month of ``end``, from ``start`` up to ``end``."""
    if 12 % per_year:
        raise ValueError("per_year must divide 12")
    step = 12 // per_year
    spine = month_spine(bounds.withColumn("_anchor", F.col(end)), start, end, name)
    apart = (F.month("_anchor") - F.month(name) + 12) % step
    return spine.filter(apart == 0).drop("_anchor")


def anchored_year_steps(bounds: DataFrame, start: str, end: str, years: int, name: str = "date") -> DataFrame:
    """Dates every ``years`` years backward from ``end`` and not before ``start``."""
    last = F.trunc(end, "month")
    count = F.floor(F.months_between(last, F.trunc(start, "month")) / (12 * years)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), count), lambda i: F.add_months(last, -12 * years * i))
    keep = [c for c in bounds.columns if c not in (start, end)]
    return bounds.select(*keep, F.explode(steps).alias(name))
