"""The country ranking table of the monthly report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.calendar import period_year
from waymark.functions.numbers import change, mean_where, ratio, sum_where, value_at
from waymark.operators.filters import month_set, not_in
from waymark.operators.joins import lookup
from waymark.operators.order import dense_position, top_with_ties
from waymark.operators.reshape import series_array


def ranking_table(
    facts: DataFrame,
    *,
    current: int,
    newer: str,
    older: str,
    top: int = 12,
    since: int | None = None,
    basis: str = "calendar",
    match: str = "date",
    require_both: bool = False,
    exclude: Sequence[str] = (),
    label: str = "citizenship",
    value: str = "encounter_count",
    date: str = "date",
) -> DataFrame:
    """Year to date, monthly mean, last month, changes and the monthly series of the top countries and the total.

    ``match='date'`` takes the two months by date; ``match='month'`` takes the latest month with the same name.
    ``require_both`` drops countries that lack either month. The total covers all countries.

    Two large shuffles: facts to month grain, month grain to country grain. All later steps work on one row per
    country, and a country's series holds one entry per month.
    """
    since = current - 3 if since is None else since
    year = period_year(date, basis)
    months = facts.filter(year >= since).groupBy(date, label).agg(F.sum(value).alias(value))
    all_months = months.groupBy(date).agg(F.sum(value).alias(value)).withColumn(label, F.lit("Total"))
    ytd = month_set(months, year >= current, value, date)

    new, old = F.lit(newer).cast("date"), F.lit(older).cast("date")

    def at(day):
        if match == "date":
            return value_at(value, F.col(date) == day)
        same = F.month(date) == F.month(day)
        return F.max_by(F.when(same, F.col(value)), F.when(same, F.col(date)))

    def summarise(rows: DataFrame) -> DataFrame:
        return rows.groupBy(label).agg(
            sum_where(value, year == current).alias("encounter"),
            mean_where(value, year == current).alias("mencounter"),
            sum_where(value, (year == current - 1) & F.array_contains(F.col("_ytd"), F.month(date))).alias("_ly"),
            at(new).alias("lastm"),
            at(old).alias("_last2m"),
            series_array(value, date).alias("spark"),
        )

    countries = summarise(months.filter(not_in(label, exclude)).withColumn("_ytd", ytd))
    if require_both:
        countries = countries.dropna(subset=["lastm", "_last2m"])
    best = top_with_ties(countries, "encounter", top, "_rank").drop("_rank")
    both = best.unionByName(summarise(all_months.withColumn("_ytd", ytd)))
    return both.select(
        label,
        "encounter",
        "mencounter",
        "lastm",
        change("lastm", "_last2m").alias("pct_change_m"),
        change("encounter", "_ly").alias("pct_change_y"),
        F.bround(ratio("lastm", "mencounter"), 1).alias("fact"),
        "spark",
    ).orderBy(F.desc("encounter"), label)


def decorate_ranking(
    table: DataFrame,
    images: DataFrame,
    relabel: dict[str, str] | None = None,
    last: str = "Other",
    label: str = "citizenship",
) -> DataFrame:
    """Flag image per row, long names shortened, display order by year to date with the residual last."""
    named = table
    for part, short in (relabel or {}).items():
        named = named.withColumn(label, F.when(F.col(label).contains(part), short).otherwise(F.col(label)))
    with_images = lookup(named, images, [label])
    key = F.when(F.col(label) == last, F.lit(-1)).otherwise(F.col("encounter"))
    placed = dense_position(with_images.withColumn("_key2", key), "_key2", "display_ord", descending=True)
    return placed.drop("_key2")
