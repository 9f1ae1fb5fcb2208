"""Aggregations, shares, indices and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.calendar import fiscal_year
from waymark.functions.numbers import ratio
from waymark.session import landed


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _on(keys: list[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return on


def total(df: DataFrame, by: list, *values: str) -> DataFrame:
    """Sums of one or more columns by keys; nulls are skipped."""
    return df.groupBy(*by).agg(*[F.sum(v).alias(v) for v in values])


def attach_group(df: DataFrame, by: list[str], stored: bool = False, **cells: Column) -> DataFrame:
    """Aggregates of a group beside each of its rows.

    The group is reduced by partial aggregation and joined back, so a group that holds a third of all rows is never
    sorted or buffered in one task. Without keys the cells come from a one-row subquery. With ``stored`` the groups are
    written out first, so that the planner knows their size and need not shuffle the rows to meet a small table.
    """
    if not by:
        out = df
        for name, cell in cells.items():
            out = out.withColumn(name, df.agg(cell).scalar())
        return out
    small = df.groupBy(*by).agg(*[c.alias(n) for n, c in cells.items()])
    small = landed(small, "groups") if stored else small
    return df.alias("l").join(small.alias("r"), _on(by)).select("l.*", *[F.col(f"r.{n}") for n in cells])


def share(df: DataFrame, value: str, by: list[str] | None = None, name: str = "share", times: float = 1.0) -> DataFrame:
    """Share of the group total, or of the global total when ``by`` is empty."""
    out = attach_group(df, list(by or []), _sum=F.sum(value))
    return out.withColumn(name, ratio(F.col(value) * F.lit(times), "_sum")).drop("_sum")


def index_to_base(df: DataFrame, value: str, base: Column, by: list[str] | None = None, name: str = "index") -> DataFrame:
    """Value relative to the group's value where ``base`` holds."""
    out = attach_group(df, list(by or []), _base=F.max(F.when(base, F.col(value))))
    return out.withColumn(name, ratio(value, "_base")).drop("_base")


def ratio_to_peer(df: DataFrame, value: str, label: str, peer: str, by: list[str] | None = None, name: str = "ratio"):
    """The peer label's value in the same group divided by the own value."""
    out = attach_group(df, list(by or []), _peer=F.max(F.when(F.col(label) == peer, F.col(value))))
    return out.withColumn(name, ratio("_peer", value)).drop("_peer")


def previous(value, order: str, by: list | None = None) -> Column:
    """Value of the period before. Use on a frame with one row per period and group."""
    return F.lag(_col(value)).over(Window.partitionBy(*(by or [])).orderBy(order))


def monthly_change(df: DataFrame, value: str, date: str = "date", by: list[str] | None = None) -> DataFrame:
    """Totals per month and their change from the month before (a gap looks back to the last reported month)."""
    months = df.groupBy(*(by or []), date).agg(F.sum(value).alias(value))
    return _with_change(months, value, date, by)


def yearly_change(df: DataFrame, value: str, year: str, by: list[str] | None = None, present: bool = False) -> DataFrame:
    """Totals per year (or other period) and their change; ``present`` drops periods without any value."""
    years = df.groupBy(*(by or []), year).agg(F.sum(value).alias(value))
    return _with_change(years.dropna(subset=[value]) if present else years, value, year, by)


def _with_change(periods: DataFrame, value: str, order: str, by: list[str] | None) -> DataFrame:
    # one row per period: the window input is bounded by the length of the calendar
    before = previous(value, order, by)
    return periods.withColumn("pct", ratio(F.col(value), before) - 1)


def mean_of_months(df: DataFrame, by: list[str], value: str, date: str = "date", start_month: int = 10) -> DataFrame:
    """Mean of the monthly totals per fiscal year."""
    months = df.groupBy(*by, date).agg(F.sum(value).alias("_m"))
    return months.groupBy(*by, fiscal_year(date, start_month).alias("fiscal_year")).agg(F.avg("_m").alias(value))


def monthly_average(value, year, current: int, months_in_current) -> Column:
    """Yearly total per month: 12 months, or the months so far in the current year."""
    return F.when(_col(year) == current, ratio(value, months_in_current)).otherwise(_col(value) / 12)


def with_total_row(df: DataFrame, label: str, by: list[str] | None = None, text: str = "Total", **cells: Column):
    """Group rows plus a total row; every cell is aggregated again for the total, never summed from ratios."""
    by = list(by or [])
    sets = [[*by, label], by]
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*by, label)])
    rows = out.agg(F.grouping(label).alias("_total"), *[c.alias(n) for n, c in cells.items()])
    named = F.when(F.col("_total") == 1, F.lit(text)).otherwise(F.col(label))
    return rows.withColumn(label, named).drop("_total")


def halve_repeats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Totals by key where the rows of a repeated key count half (each block of the sheet lists them twice).

    ``sum(v / 2)`` equals ``sum(v) / 2``, so one partial aggregation does it.
    """
    summed = F.sum(value)
    return df.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 1, summed / 2).otherwise(summed.cast("double")).alias(value)
    )


def control_total(df: DataFrame, by: list[str], value: str, known: DataFrame, tolerance: float) -> DataFrame:
    """Report of totals against known control totals (columns ``by`` and ``known``)."""
    small = df.groupBy(*by).agg(F.sum(value).alias(value))
    joined = small.alias("l").join(known.alias("r"), _on(by)).select("l.*", "r.known")
    gap = F.abs(F.col(value) - F.col("known"))
    return joined.withColumn("ok", gap <= F.abs(F.col("known")) * tolerance)


def two_date_difference(df: DataFrame, value: str, newer, older, date: str = "date") -> DataFrame:
    """Totals at two dates with difference, percent and factor, as one row."""
    at = [F.lit(d).cast("date") for d in (newer, older)]
    row = df.filter(F.col(date).isin(*at)).agg(
        F.sum(F.when(F.col(date) == at[1], F.col(value))).alias("m1"),
        F.sum(F.when(F.col(date) == at[0], F.col(value))).alias("m2"),
    )
    return row.select(
        "m1",
        "m2",
        (F.col("m2") - F.col("m1")).alias("diff"),
        ratio((F.col("m2") - F.col("m1")) * F.lit(100.0), "m1").alias("pct"),
        ratio("m2", "m1").alias("fct"),
    )


def latest_two(df: DataFrame, value: str, date: str = "date") -> DataFrame:
    """Latest month's total and its difference from the month before it."""
    last = df.groupBy(date).agg(F.sum(value).alias(value)).orderBy(F.desc(date)).limit(2)
    packed = F.array_sort(F.collect_list(F.struct(F.col(date), F.col(value))))
    return last.agg(packed.alias("p")).select(
        F.try_element_at("p", F.lit(-1))[date].alias("date"),
        F.try_element_at("p", F.lit(-1))[value].alias("latest"),
        (F.try_element_at("p", F.lit(-1))[value] - F.try_element_at("p", F.lit(-2))[value]).alias("difference"),
    )
