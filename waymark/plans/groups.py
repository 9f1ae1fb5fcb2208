"""Country groups, residual groups and share tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.numbers import ratio
from waymark.operators.aggregates import attach_group
from waymark.operators.joins import lookup, on_keys
from waymark.operators.order import magnitude_block, running_total

# Country groups of the border reports.
NCA = ["GUATEMALA", "HONDURAS", "EL SALVADOR"]
CHNV = ["CUBA", "NICARAGUA", "VENEZUELA", "HAITI"]
GROUPS = {"NORTHERN CENTRAL AMERICA": NCA, "CHNV COUNTRIES": CHNV, "MEXICO": ["MEXICO"]}
SUBREGIONS = {
    "Mexico": ["MEXICO"],
    "nca": [*NCA, "NICARAGUA"],
    "sa": ["VENEZUELA", "COLOMBIA", "PERU", "ECUADOR", "BRAZIL"],
    "car": ["HAITI", "CUBA"],
}


def group_label(column, groups: dict[str, list[str]], other: str | None = "OTHER") -> Column:
    """Group of a label; labels in no group get ``other`` (or keep their own name when it is None)."""
    c = F.col(column) if isinstance(column, str) else column
    out = None
    for name, labels in groups.items():
        out = F.when(c.isin(labels), name) if out is None else out.when(c.isin(labels), name)
    return out.otherwise(c if other is None else F.lit(other))


def collapse_outside(df: DataFrame, label: str, keep: list[str], by: list[str], value: str, other: str = "OTHER"):
    """Totals with every label outside the list merged into one residual; null labels join the residual."""
    merged = F.when(F.col(label).isin(keep), F.col(label)).otherwise(F.lit(other))
    return df.groupBy(*by, merged.alias(label)).agg(F.sum(value).alias(value))


def small_labels(totals: DataFrame, label: str, value: str, least: float, strict: bool, digits: int | None) -> DataFrame:
    """Labels with their share of all and whether they are large enough to be shown."""
    part = ratio(value, totals.agg(F.sum(value)).scalar())
    if digits is not None:
        part = F.bround(part, digits)
    return totals.select(label, F.coalesce(part > least if strict else part >= least, F.lit(False)).alias("_shown"))


def collapse_small(
    df: DataFrame,
    label: str,
    value: str,
    least: float,
    by: list[str] | None = None,
    other: str = "Other",
    strict: bool = True,
    digits: int | None = None,
    basis: DataFrame | None = None,
) -> DataFrame:
    """Totals with labels of a small share merged into a residual.

    The share is of the totals of ``basis`` (the frame itself by default). ``strict`` keeps a label above the limit,
    otherwise at or above it; ``digits`` rounds the share first.
    """
    by = list(by or [])
    totals = (df if basis is None else basis).groupBy(label).agg(F.sum(value).alias(value))
    shown = small_labels(totals, label, value, least, strict, digits)
    small = df.groupBy(*by, label).agg(F.sum(value).alias(value))
    joined = small.alias("l").join(shown.alias("r"), on_keys([label], null_safe=True), "left")
    merged = F.when(F.col("r._shown"), F.col(f"l.{label}")).otherwise(F.lit(other))
    cells = joined.select(*[F.col(f"l.{b}") for b in by], merged.alias(label), F.col(f"l.{value}"))
    return cells.groupBy(*by, label).agg(F.sum(value).alias(value))


def share_area(totals: DataFrame, label: str, value: str, subregions: dict[str, list[str]], other: str = "Other"):
    """Share table of collapsed totals: percent share, residual label hidden, subregion, cumulative percent."""
    rows = attach_group(totals, [], _all=F.sum(value))
    order = [F.desc(value), F.asc(label)]
    rows = running_total(rows, value, order, -magnitude_block(value), "_upto")
    return rows.select(
        label,
        value,
        ratio(F.col(value) * F.lit(100.0), "_all").alias("share"),
        F.when(F.col(label) != other, F.col(label)).alias("other"),
        group_label(label, subregions, "Other").alias("subregion"),
        ratio(F.col("_upto") * F.lit(100.0), "_all").alias("cumulative_share"),
    )


def per_capita(counts: DataFrame, pop: DataFrame, keys: list[str], value: str, per: float = 1e5, name: str = "percap_count"):
    """Counts per inhabitants; ``keys`` join the counts to the population table."""
    joined = lookup(counts, pop.select(*keys, "pop"), keys)
    return joined.withColumn(name, ratio(F.col(value) * F.lit(per), "pop"))
