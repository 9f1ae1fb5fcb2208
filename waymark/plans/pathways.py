"""Legal pathways, growth tables, estimates and deflation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.calendar import fiscal_year, month_spine
from waymark.functions.numbers import compound_growth, ratio, zero_to_null
from waymark.operators.aggregates import attach_group, index_to_base
from waymark.operators.joins import lookup
from waymark.operators.reshape import stack, to_wide


def pathway_composite(yearly: list[DataFrame], monthly: dict[str, DataFrame], since: int) -> DataFrame:
    """Issuances per fiscal year and pathway with the year's total.

    ``yearly`` frames hold ``fiscal_year, cat, value``; ``monthly`` frames hold ``date, value`` under their pathway.
    Each source is summed before the union, so only small tables meet.
    """
    parts = [f.groupBy("fiscal_year", "cat").agg(F.sum("value").alias("value")) for f in yearly]
    for name, frame in monthly.items():
        rows = frame.groupBy(fiscal_year("date").alias("fiscal_year")).agg(F.sum("value").alias("value"))
        parts.append(rows.withColumn("cat", F.lit(name)))
    both = stack(*parts).filter(F.col("fiscal_year") >= since)
    totals = both.groupBy("fiscal_year", "cat").agg(F.sum("value").alias("value"))
    return attach_group(totals, ["fiscal_year"], sval=F.sum("value"))


def growth_table(
    yearly: DataFrame, label: str, first: int, last: int, base: dict[str, int] | None = None, year="fiscal_year",
    value: str = "value",
) -> DataFrame:
    """Total change and compound annual growth per row; some rows start from another base year."""
    base = base or {}
    years = sorted({first, last, *base.values()})
    wide = to_wide(yearly, [label], year, years, value, fill=0)
    start, span = F.col(str(first)), F.lit(last - first)
    for name, y in base.items():
        start = F.when(F.col(label) == name, F.col(str(y))).otherwise(start)
        span = F.when(F.col(label) == name, last - y).otherwise(span)
    end = F.col(str(last))
    return wide.select(
        label,
        zero_to_null(start).alias("first_value"),
        zero_to_null(end).alias("last_value"),
        zero_to_null(ratio(end - start, start)).alias("pct_change"),
        zero_to_null(compound_growth(start, end, span)).alias("cagr"),
    )


def policy_estimate(bounds: DataFrame, start: str, end: str, amount, category: str) -> DataFrame:
    """A monthly amount set by policy on a month spine, summed per fiscal year."""
    months = month_spine(bounds, start, end).withColumn("value", amount)
    rows = months.groupBy(fiscal_year("date").alias("fiscal_year")).agg(F.sum("value").alias("value"))
    return rows.select(F.lit(category).alias("cat"), "fiscal_year", "value")


def deflate(prices: DataFrame, value: str, base: str, amount: float, date: str = "date") -> DataFrame:
    """Price index with base 1 and what a fixed amount is worth at each date."""
    at_base = F.col(date) == F.lit(base).cast("date")
    indexed = index_to_base(prices, value, at_base, name="price_index")
    return indexed.withColumn("worth", ratio(F.lit(amount), "price_index"))


def undetected(counts: DataFrame, rates: DataFrame, before: int) -> DataFrame:
    """Estimated undetected entries from the detection rate, with the detected ones, per fiscal year, long."""
    joined = lookup(counts, rates, ["date"])
    made = joined.select(
        fiscal_year("date").alias("fiscal_year"),
        F.col("encounter_count").cast("double").alias("apprehensions"),
        (ratio("encounter_count", "rate") - F.col("encounter_count")).alias("undetected"),
    )
    long = made.filter(F.col("fiscal_year") < before).unpivot(
        ["fiscal_year"], ["apprehensions", "undetected"], "cat", "entry_count"
    )
    return long.groupBy("fiscal_year", "cat").agg(F.sum("entry_count").alias("entry_count"))


def age_difference(ages: DataFrame, name: str, region: str, threshold: float = 1.0) -> DataFrame:
    """Age shares of two populations, their difference in percentage points and whether it is significant."""
    rows = ages.filter(F.col("name").isin(name, region)).groupBy("name", "age").agg(F.sum("value").alias("value"))
    shares = attach_group(rows, ["name"], _t=F.sum("value")).withColumn("pct_age", ratio("value", "_t"))
    wide = to_wide(shares, ["age"], "name", [name, region], "pct_age")
    points = (F.col(name) - F.col(region)) * 100
    flagged = F.abs(points) >= threshold
    return wide.select(
        "age",
        F.col(name).alias("pct_name"),
        F.col(region).alias("pct_region"),
        points.alias("diff_percent"),
        flagged.alias("significant"),
        F.when(flagged, points).alias("diff_significant"),
    )
