"""Monthly and yearly series of the reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.calendar import fiscal_year
from waymark.functions.numbers import ratio, sum_where
from waymark.operators.aggregates import (
    attach_group,
    index_to_base,
    monthly_average,
    monthly_change,
    share,
    yearly_change,
)
from waymark.operators.cleaning import recode
from waymark.operators.filters import before_first, in_months, not_in
from waymark.operators.joins import lookup, override, subtract_part
from waymark.operators.order import at_latest, by_order, ranked_labels, top_with_ties
from waymark.operators.reshape import densify, full_grid, stack, stack_tagged, to_wide, to_wide_many
from waymark.plans.groups import group_label
from waymark.session import landed

VALUE = "encounter_count"


def header_indicators(facts: DataFrame, as_of: str, months: list[int], value: str = VALUE) -> DataFrame:
    """Monthly totals, same-months totals per year, and totals per component at one date, each with its change.

    Components are compared in name order.
    """
    # conditions stand inside the sums: all three tables read one shuffle of the month x component totals
    cells = facts.groupBy("date", "component").agg(F.sum(value).alias(value))
    month = monthly_change(cells, value).select(F.date_format("date", "yyyy-MM-dd").alias("period"), value, "pct")
    ytd = F.when(in_months("date", months), F.col(value)).alias(value)
    years = yearly_change(cells.select(F.year("date").alias("_y"), ytd), value, "_y", present=True)
    year = years.select(F.col("_y").cast("string").alias("period"), value, "pct")
    own = F.when(F.col("date") == F.lit(as_of).cast("date"), F.col(value)).alias(value)
    parts = yearly_change(cells.select("component", own), value, "component", present=True)
    part = parts.select(F.col("component").alias("period"), value, "pct")
    return stack_tagged({"month": month, "year_to_date": year, "component": part}, "indicator")


def component_split(facts: DataFrame, between_ports: list[str], since: int, value: str = VALUE) -> DataFrame:
    """Monthly totals per component with its display label."""
    fy = fiscal_year("date")
    label = F.when(F.col("component").isin(between_ports), "Between Ports of Entry").otherwise("At Ports of Entry")
    rows = facts.filter(fy >= since).groupBy("date", fy.alias("fiscal_year"), "component").agg(F.sum(value).alias(value))
    return rows.withColumn("lab2", label)


def component_share(facts: DataFrame, groups: dict[str, list[str]], component: str, value: str = VALUE) -> DataFrame:
    """Share of one component in each group's month, one column per group."""
    label = group_label("citizenship", groups)
    parts = facts.groupBy("date", label.alias("grp"), "component").agg(F.sum(value).alias(value))
    shares = share(parts, value, ["date", "grp"], "pct").filter(F.col("component") == component)
    return to_wide(shares, ["date"], "grp", [*groups, "OTHER"], "pct")


def demographic_share(facts: DataFrame, demographic: str, value: str = VALUE) -> DataFrame:
    """Share of one demographic in each month's total."""
    parts = facts.groupBy("date", "demographic").agg(F.sum(value).alias(value))
    return share(parts, value, ["date"], "freq").filter(F.col("demographic") == demographic)


def demographic_series(
    facts: DataFrame, countries: list[str], labels: dict[str, str], order: list[str], value: str = VALUE
) -> DataFrame:
    """Monthly counts per demographic for some countries: absent cells 0, display labels in a set order, month total.

    A demographic without a label keeps its own name and comes last; it counts in the month total like the others.
    """
    some = facts.filter(F.col("citizenship").isin(countries))
    grid = full_grid(some, "date", "demographic", value)
    listed = grid.filter(F.col("demographic").isin(list(labels)))
    # labels that no row has still get their zeros
    missing = densify(listed, ["date"], "demographic", list(labels), value)
    dense = missing.unionByName(grid.filter(not_in("demographic", labels)))
    label = recode("demographic", labels)
    named = attach_group(dense.withColumn("label", label), ["date"], summig=F.sum(value))
    return named.withColumn("label_ord", by_order("label", order))


def group_share_wide(facts: DataFrame, groups: dict[str, list[str]], period, name: str, value: str = VALUE) -> DataFrame:
    """Totals of two groups side by side per period and the first group's share of both."""
    first = next(iter(groups))
    rows = facts.groupBy(period.alias(name), group_label("citizenship", groups, "Other").alias("grp"))
    wide = to_wide(rows.agg(F.sum(value).alias(value)), [name], "grp", [first, "Other"], value)
    return wide.withColumn("pct", ratio(first, F.col(first) + F.col("Other")))


def two_date_table(facts: DataFrame, keep: list[str], dates: list[str], value: str = VALUE) -> DataFrame:
    """Counts and month shares at a few dates, one row per label; labels outside the list form the residual.

    The dates are cut before anything is summed: a month's share needs that month only.
    """
    at = [F.lit(d).cast("date") for d in dates]
    label = F.when(F.col("citizenship").isin(keep), F.col("citizenship")).otherwise("Other")
    rows = facts.filter(F.col("date").isin(*at)).groupBy("date", label.alias("citizenship"))
    shares = share(rows.agg(F.sum(value).alias(value)), value, ["date"], "pct")
    keyed = shares.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    return to_wide_many(keyed, ["citizenship"], "date", dates, [value, "pct"])


def year_comparison(facts: DataFrame, months: list[int], current: int, months_so_far: int, base: int, value: str = VALUE):
    """Fiscal-year total, same-months total, monthly mean and same-months change against a base year."""
    rows = facts.groupBy(fiscal_year("date").alias("fiscal_year")).agg(
        F.sum(value).alias("total"), sum_where(value, in_months("date", months)).alias("same_months")
    )
    rows = rows.withColumn("mean", monthly_average("total", "fiscal_year", current, F.lit(months_so_far)))
    indexed = index_to_base(rows, "same_months", F.col("fiscal_year") == base, name="change")
    return indexed.withColumn("change", F.col("change") - 1)


def long_history(
    history: DataFrame, better: DataFrame, live: DataFrame, cut: int, current: int, months_so_far: int, value: str = "apps"
) -> DataFrame:
    """Yearly history up to a cut with corrected years, live years from the cut, and the mean per month."""
    early = override(history.filter(F.col("fiscal_year") < cut), better, ["fiscal_year"], value)
    late = live.filter((F.col("fiscal_year") >= cut) & (F.col("fiscal_year") <= current))
    both = stack(early.select("fiscal_year", value), late.select("fiscal_year", value))
    return both.withColumn("appsm", monthly_average(value, "fiscal_year", current, F.lit(months_so_far)))


def long_history_groups(
    old: DataFrame, part: DataFrame, live: DataFrame, part_label: str, rest_label: str, groups: dict[str, list[str]],
    value: str = VALUE,
) -> DataFrame:
    """Monthly group shares over old and live data.

    The old source has no own series for ``part_label``: another source gives it, and it is taken out of the old
    residual. Both end before the first live month.
    """
    late = live.groupBy("date", "citizenship").agg(F.sum(value).alias(value))
    own = part.filter(F.col("citizenship") == part_label)
    early = stack(before_first(old, late, shared=value), before_first(own, late, shared=value))
    early = early.groupBy("date", "citizenship").agg(F.sum(value).alias(value))
    fixed = subtract_part(early, part_label, rest_label, value)
    label = group_label("citizenship", groups)
    both = stack(fixed, late).groupBy("date", label.alias("citizenship")).agg(F.sum(value).alias(value))
    return share(both, value, ["date"], "freq")


def yearly_group_share(sources: dict[str, DataFrame], value: str = VALUE) -> DataFrame:
    """Group shares per fiscal year over several sources of disjoint years (``fiscal_year``, ``g1``, value)."""
    both = stack_tagged({k: v.select("fiscal_year", "g1", value) for k, v in sources.items()}, "source")
    rows = both.groupBy("source", "fiscal_year", "g1").agg(F.sum(value).alias(value))
    return share(rows, value, ["source", "fiscal_year"], "freq")


def top_other_series(facts: DataFrame, exclude: list[str], n: int, chosen: Column | None = None, value: str = VALUE):
    """Monthly series of the largest countries outside a list, ordered by their totals.

    The top is taken at the latest month, or over the months where ``chosen`` holds. The facts are read once, into
    month totals that are written out and serve the choice and the series.
    """
    months = landed(facts.groupBy("date", "citizenship").agg(F.sum(value).alias(value)), "months")
    window = at_latest(months) if chosen is None else months.filter(chosen)
    totals = window.filter(not_in("citizenship", exclude)).groupBy("citizenship").agg(F.sum(value).alias(value))
    best = top_with_ties(totals, value, n).select("citizenship")
    series = months.join(best, "citizenship", "left_semi")
    return ranked_labels(series.select("date", "citizenship", value), "citizenship", value, "citizenship_ord")


def regular_irregular(regular: DataFrame, irregular: DataFrame, value: str = "count") -> DataFrame:
    """Regular arrivals from the first irregular month on, stacked with irregular encounters."""
    cut = irregular.agg(F.min("date")).scalar()
    a = regular.filter(F.col("date") >= cut).groupBy("date").agg(F.sum(value).alias(value))
    b = irregular.groupBy("date").agg(F.sum(value).alias(value))
    return stack_tagged({"Regular": a, "Irregular": b}, "component")


def encounters_and_returns(encounters: DataFrame, returns: DataFrame) -> DataFrame:
    """Monthly encounters with the returns of the same month, long."""
    a = encounters.groupBy("date").agg(F.sum(VALUE).alias(VALUE))
    b = returns.groupBy("date").agg(F.sum("returns").alias("returns"))
    return lookup(a, b, ["date"]).unpivot(["date"], [VALUE, "returns"], "name", "value")


