"""Displacement measures and origin x host comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.numbers import ratio
from waymark.operators.aggregates import attach_group
from waymark.operators.filters import members
from waymark.operators.joins import both_roles, combine_sources, lookup
from waymark.operators.reshape import to_long, to_wide
from waymark.plans.groups import group_label
from waymark.sources.delimited import inline_table

PAIR = ["year", "coo_iso", "coa_iso"]

# The columns that each displacement measure adds up.
MEASURES = {
    "dp": ["refugees", "asylum_seekers", "oip"],
    "dp_pal": ["refugees", "asylum_seekers", "oip", "pal_ref"],
    "fdp": ["refugees", "asylum_seekers", "oip", "idps", "pal_ref"],
    "fidp": ["refugees", "asylum_seekers", "oip", "pal_ref"],
    "fdp_idmc": ["idmc", "oip", "refugees", "unrwa", "asylum_seekers"],
    "fdps": ["idps", "oip", "refugees", "unrwa", "asylum_seekers", "ooc", "stateless"],
    "fdpa": ["oip", "refugees", "unrwa", "asylum_seekers"],
    "flow_fdpa": ["oip", "refugees", "asylum_seekers", "refugee_like"],
    "flow_fdp": ["oip", "refugees", "asylum_seekers", "refugee_like", "conflict_internal_displacements"],
}


def measure(name: str) -> Column:
    """A displacement measure; a missing part counts 0."""
    out = None
    for c in MEASURES[name]:
        part = F.coalesce(F.col(c), F.lit(0))
        out = part if out is None else out + part
    return out


def with_measures(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Add measures (output column -> measure name)."""
    return df.withColumns({column: measure(name) for column, name in names.items()})


def scale_pair(df: DataFrame, column: str, origin: str, host: str, factor: float = 0.3) -> DataFrame:
    """Scale one pair's count, which two sources report in part."""
    hit = (F.col("coo_iso") == origin) & (F.col("coa_iso") == host)
    return df.withColumn(column, F.when(hit, F.col(column) * factor).otherwise(F.col(column).cast("double")))


def stock(population: DataFrame, internal: DataFrame, camps: DataFrame, doubled: str) -> DataFrame:
    """Joined stock sources with the double count of one country corrected and the three forced-displacement sums."""
    both = combine_sources([population, internal, camps], PAIR)
    fixed = scale_pair(both, "idmc", doubled, doubled)
    present = set(fixed.columns)
    for c in MEASURES["fdps"]:
        if c not in present:
            fixed = fixed.withColumn(c, F.lit(0))
    return with_measures(fixed, {"fdp": "fdp_idmc", "fdps": "fdps", "fdpa": "fdpa"})


def flows(cross_border: DataFrame, internal: DataFrame, key: str = "iso3") -> DataFrame:
    """Yearly flow measures per pair: cross-border flows joined to internal displacement of the same country."""
    own = both_roles(internal, key, ["coo_iso", "coa_iso"])
    rows = combine_sources([cross_border, own], PAIR)
    made = with_measures(rows, {"fdpa": "flow_fdpa", "fdp": "flow_fdp"})
    return made.groupBy(*PAIR).agg(
        *[F.sum(c).alias(c) for c in ("fdp", "fdpa", "conflict_internal_displacements")]
    )


def host_group(column: str, host: str, rest: str) -> Column:
    """One host country against all others."""
    return F.when(F.col(column) == host, host).otherwise(rest)


def scope(df: DataFrame, region: DataFrame, host: str, key: str = "iso_code") -> DataFrame:
    """Origins in the region; hosts in the region or the one host."""
    hosts = region.select(key).unionByName(inline_table(df.sparkSession, [(host,)], f"{key} string")).distinct()
    return members(members(df, "coo_iso", region, key), "coa_iso", hosts, key)


def stock_difference(df: DataFrame, y1: int, y2: int, var: str, host: str, rest: str = "LAC") -> DataFrame:
    """Change of a stock between two years per host group."""
    rows = df.filter(F.col("year").isin(y1, y2)).groupBy("year", host_group("coa_iso", host, rest).alias("coa_g"))
    wide = to_wide(rows.agg(F.sum(var).alias(var)), ["coa_g"], "year", [y1, y2], var)
    named = wide.select("coa_g", F.col(str(y1)).alias("y1"), F.col(str(y2)).alias("y2"))
    return named.withColumn("diff", F.col("y2") - F.col("y1"))


def flow_difference(df: DataFrame, y1: int, y2: int, var: str, host: str, rest: str = "LAC") -> DataFrame:
    """Sum of a flow over a span of years per host group."""
    rows = df.filter(F.col("year").between(y1, y2))
    return rows.groupBy(host_group("coa_iso", host, rest).alias("coa_g")).agg(F.sum(var).alias(var))


def relative_displacement(
    df: DataFrame, bases: list[int], last: int, var: str, host: str, rest: str = "LAC", inclusive: bool = True
) -> DataFrame:
    """Flows since each base year: the rest relative to the host, and the host's share.

    One job for all base years: the flows shrink to one row per year and host group, and each such row is copied to
    the base years it belongs to, so no join over a range of years is needed.
    """
    yearly = df.filter(F.col("year") <= last).groupBy("year", host_group("coa_iso", host, rest).alias("coa_g"))
    yearly = yearly.agg(F.sum(var).alias(var))
    starts = F.array(*[F.lit(b) for b in bases])
    inside = F.filter(starts, lambda b: F.col("year") >= b if inclusive else F.col("year") > b)
    spans = yearly.select(F.explode(inside).alias("base_year"), "coa_g", var)
    wide = to_wide(spans, ["base_year"], "coa_g", [host, rest], var)
    return wide.select(
        "base_year",
        F.col(host).alias("host_total"),
        F.col(rest).alias("rest_total"),
        ratio(rest, host).alias("relative"),
        ratio(host, F.col(host) + F.col(rest)).alias("host_share"),
    )


def internal_with_flow(
    cross_border: DataFrame, internal: DataFrame, since: int, host: str, rest: str = "LAC", key: str = "iso3"
) -> DataFrame:
    """Cross-border flow with the internal displacement of the same host group, summed over the years after ``since``."""
    own = internal.groupBy("year", host_group(key, host, rest).alias("coa_g")).agg(
        F.sum("conflict_internal_displacements").alias("conflict_internal_displacements"),
        F.sum("disaster_internal_displacements").alias("disaster_internal_displacements"),
    )
    flow = cross_border.filter(F.col("year") > since).groupBy("year", host_group("coa_iso", host, rest).alias("coa_g"))
    both = lookup(flow.agg(F.sum("fdp").alias("fdp")), own, ["year", "coa_g"])
    both = both.withColumn("fdp2", F.col("fdp") + F.col("conflict_internal_displacements"))
    sums = ("fdp", "fdp2", "conflict_internal_displacements")
    return both.groupBy("coa_g").agg(*[F.sum(c).alias(c) for c in sums])


def series_by_class(df: DataFrame, var: str, origins: dict[str, list[str]], host: str, rest: str) -> DataFrame:
    """Yearly totals by origin class and host class."""
    origin = group_label("coo_iso", origins, "Extraregional")
    keys = ["year", origin.alias("origin_class"), host_group("coa_iso", host, rest).alias("host_class")]
    return df.groupBy(*keys).agg(F.sum(var).alias(var))


def dual_series(df: DataFrame, var: str, origin: str, host: str, rest: str) -> DataFrame:
    """Yearly totals by host class for all origins and for one origin, long."""
    one = F.when(F.col("coo_iso") == origin, F.col(var)).otherwise(F.lit(0))
    rows = df.groupBy("year", host_group("coa_iso", host, rest).alias("host_class")).agg(
        F.sum(var).alias("all_origins"), F.sum(one).alias("one_origin")
    )
    return to_long(rows, ["year", "host_class"], ["all_origins", "one_origin"], "measure", var)


def host_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of all measures per host with the grand total beside."""
    rows = df.groupBy("coa_iso").agg(*[F.sum(c).alias(c) for c in columns])
    return attach_group(rows, [], **{f"all_{c}": F.sum(c) for c in columns})
