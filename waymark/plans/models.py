"""Curves through series: natural cubic interpolation and natural-spline regression.

Both run over many series at once. Spark reduces the facts to one row per series and month; Python only solves the
small linear system of one series, whose length is bounded by the calendar.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.numbers import ratio


def yearly_to_monthly(yearly: DataFrame, series: str, year: str, value: str) -> DataFrame:
    """Monthly values from January of a series' first year to January of its last year, on the natural cubic spline.

    ``yearly`` holds one row per series and year. The years themselves are the places of the curve, so a gap is bridged
    with its true width. A group is as long as its years.
    """

    def natural_spline(x, y, at):
        if len(x) == 1:
            return np.repeat(y[0], len(at))
        h, n = np.diff(x), len(x)
        second = np.zeros(n)
        if n > 2:
            system = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
            second[1:-1] = np.linalg.solve(system, 6 * np.diff(np.diff(y) / h))
        i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
        w = h[i]
        b = (at - x[i]) / w
        a = 1 - b
        return a * y[i] + b * y[i + 1] + ((a**3 - a) * second[i] + (b**3 - b) * second[i + 1]) * w**2 / 6

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(year)
        x = rows[year].to_numpy(dtype=float)
        dates = pd.date_range(f"{int(x[0])}-01-01", f"{int(x[-1])}-01-01", freq="MS")
        curve = natural_spline(x, rows[value].to_numpy(dtype=float), x[0] + np.arange(len(dates)) / 12)
        return pd.DataFrame({series: [rows[series].iloc[0]] * len(dates), "date": dates.date, value: curve})

    small = yearly.select(series, year, F.col(value).cast("double").alias(value))
    kind = yearly.schema[series].dataType.simpleString()
    return small.groupBy(series).applyInPandas(fill, f"`{series}` {kind}, date date, `{value}` double")


def _basis(x: Column, knots: list[Column]) -> list[Column]:
    """Natural cubic basis on six knots: linear beyond the outer ones. Its span does not depend on the scaling."""

    def cube(t: Column) -> Column:
        d = F.greatest(x - t, F.lit(0.0))
        return d * d * d

    last = knots[-1]

    def slope(k: int) -> Column:
        return (cube(knots[k]) - cube(last)) / (last - knots[k])

    base = slope(len(knots) - 2)
    return [F.lit(1.0), x, *[slope(k) - base for k in range(len(knots) - 2)]]


def spline_regression(months: DataFrame, series: str, value: str, df: int = 5, date: str = "date") -> DataFrame:
    """Least-squares fit of each monthly series on a natural cubic spline with ``df`` degrees of freedom.

    Knots are the end months and the ``1/df ... (df-1)/df`` quantiles of the months. The basis is made of column
    expressions; the least squares of one series, a row per month, are solved in Python.
    """
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date")).cast("double")
    rows = months.filter(F.col(value).isNotNull()).withColumn("_t", day)
    cuts = F.array(*[F.lit(i / df) for i in range(df + 1)])
    spans = rows.groupBy(series).agg(F.percentile("_t", cuts).alias("_k"))
    both = rows.alias("l").join(spans.alias("r"), F.col(f"l.{series}").eqNullSafe(F.col(f"r.{series}")))
    both = both.select("l.*", "r._k")
    width = F.get("_k", F.lit(df)) - F.get("_k", F.lit(0))
    scaled = both.withColumn("_x", ratio(F.col("_t") - F.get("_k", F.lit(0)), width))
    knots = [(F.get("_k", F.lit(i)) - F.get("_k", F.lit(0))) / width for i in range(df + 1)]
    n = df + 1
    # with fewer distinct months than the curve has knots, a series keeps its own values
    usable = F.size(F.array_distinct("_k")) == n
    b = scaled.withColumn("_b", F.when(usable, F.array(*_basis(F.col("_x"), knots))))

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        y = group[value].to_numpy(dtype=float)
        if group["_b"].iloc[0] is not None:
            design = np.array(group["_b"].tolist(), dtype=float)
            # orthogonal factors of the basis itself: its condition number is not squared
            y = design @ np.linalg.lstsq(design, y, rcond=None)[0]
        return group.drop(columns="_b").assign(predicted=y)

    kinds = {f.name: f.dataType.simpleString() for f in months.schema.fields}
    columns = ", ".join(f"`{c}` {kinds[c]}" for c in (series, date, value))
    return b.select(series, date, value, "_b").groupBy(series).applyInPandas(solve, f"{columns}, predicted double")
