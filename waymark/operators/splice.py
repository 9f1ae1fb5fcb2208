"""Joining history to live data without overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.filters import after_last, before_first
from waymark.operators.reshape import stack


def splice_before(old: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """History strictly before the first new date, then the new data."""
    return stack(before_first(old, new, date), new)


def splice_after(history: DataFrame, live: DataFrame, value: str, by: list[str] | None = None, date: str = "date"):
    """All history, then the live totals strictly after its last date."""
    by = [date, *(by or [])]
    # summing commutes with the date cut, so the cut reaches the scan
    newer = after_last(live, history, date).groupBy(*by).agg(F.sum(value).alias(value))
    return stack(history, newer)


def splice_at(old: DataFrame, new: DataFrame, is_old: Column, is_new: Column) -> DataFrame:
    """Old rows on one side of a fixed cut, new rows on the other."""
    return stack(old.filter(is_old), new.filter(is_new))


def append_projection(df: DataFrame, estimate: DataFrame, as_of, date: str = "date") -> DataFrame:
    """Add estimated rows and flag every row at or after the as-of date."""
    return stack(df, estimate).withColumn("proj", F.col(date) >= F.lit(as_of).cast("date"))


def without(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of ``left`` absent from ``right``."""
    return left.subtract(right)
