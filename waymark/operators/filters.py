"""Row selection. A null never satisfies ``in`` and always satisfies ``not in``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.order import sharing
from waymark.session import landed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_in(column, values) -> Column:
    """True outside the list, and for null."""
    return ~F.coalesce(_col(column).isin(list(values)), F.lit(False))


def in_months(date, months) -> Column:
    """Month of year in a set, for year-to-date comparisons."""
    return F.month(_col(date)).isin(list(months))


def month_set(months: DataFrame, condition: Column, value: str, date: str = "date") -> Column:
    """The months of year (at most 12) present where a condition is met, as an array to test against.

    ``months`` is a month-grain frame. The condition stands inside the aggregate, so the subquery reads the very
    shuffle that the caller reads and the facts are scanned once.
    """
    return months.agg(F.collect_set(F.when(condition, sharing(F.month(date), value)))).scalar()


def year_to_date(df: DataFrame, period: Column, current: int, date: str = "date") -> DataFrame:
    """Rows of any year whose month also occurs in the current year."""
    seen = df.filter(period >= current).agg(F.collect_set(F.month(date))).scalar()
    return df.filter(F.array_contains(seen, F.month(date)))


def before_first(df: DataFrame, other: DataFrame, date: str = "date", shared: str | None = None) -> DataFrame:
    """Rows strictly before the first date of another frame.

    When the caller also uses the aggregated frame ``other``, ``shared`` names its measure so that it is read once.
    """
    day = F.col(date) if shared is None else sharing(date, shared)
    return df.filter(F.col(date) < other.agg(F.min(day)).scalar())


def after_last(df: DataFrame, other: DataFrame, date: str = "date") -> DataFrame:
    """Rows strictly after the last date of another frame."""
    return df.filter(F.col(date) > other.agg(F.max(date)).scalar())


def keep_groups(df: DataFrame, by: list[str], value: str, least: float = 0, stored: bool = False) -> DataFrame:
    """Rows of the groups whose total exceeds ``least``; totals are aggregated first, so no group is sorted whole.

    With ``stored`` the kept groups are written out first. The planner then knows their size: below its threshold it
    broadcasts them and the rows are not shuffled at all.
    """
    good = df.groupBy(*by).agg(F.sum(value).alias("_t")).filter(F.col("_t") > least).drop("_t")
    good = landed(good, "groups") if stored else good
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return df.alias("l").join(good.alias("r"), on, "left_semi")


def across_borders(df: DataFrame, origin: str = "coo_iso", host: str = "coa_iso") -> DataFrame:
    """Drop pairs of a country with itself."""
    return df.filter(F.col(origin) != F.col(host))


def members(df: DataFrame, column: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose label is in a dimension subset."""
    return df.join(dim.select(F.col(key).alias("_m")), F.col(column) == F.col("_m"), "left_semi")


def outsiders(df: DataFrame, column: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose label is not in a dimension subset; null labels stay."""
    return df.join(dim.select(F.col(key).alias("_m")), F.col(column) == F.col("_m"), "left_anti")
