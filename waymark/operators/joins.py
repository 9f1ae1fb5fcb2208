"""Joins. Keys are always explicit.

No broadcast hints on frames of unknown size: small dimensions are broadcast by the planner or by adaptive execution
once their size is known to lie below ``spark.sql.autoBroadcastJoinThreshold``; larger ones fall back to a shuffled
join with skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def on_keys(keys: list[str], left: str = "l", right: str = "r", null_safe: bool = False) -> Column:
    out = None
    for k in keys:
        a, b = F.col(f"{left}.{k}"), F.col(f"{right}.{k}")
        test = a.eqNullSafe(b) if null_safe else a == b
        out = test if out is None else out & test
    return out


def unique_by(dim: DataFrame, keys: list[str], any_match: bool = False) -> DataFrame:
    """One row per key. A repeated key fails the job, or with ``any_match`` keeps the least row."""
    rest = [c for c in dim.columns if c not in keys]
    row = F.min(F.struct(*rest)).alias("_row") if rest else F.count(F.lit(1)).alias("_row")
    packed = dim.groupBy(*keys).agg(row, F.count(F.lit(1)).alias("_n"))
    if not any_match:
        alarm = F.raise_error(F.concat(F.lit("repeated key in dimension: "), F.to_json(F.struct(*keys))))
        packed = packed.withColumn("_n", F.when(F.col("_n") > 1, alarm.cast("bigint")).otherwise(F.col("_n")))
        packed = packed.filter(F.col("_n") == 1)
    return packed.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def lookup(
    fact: DataFrame, dim: DataFrame, keys: list[str], null_safe: bool = False, any_match: bool = False
) -> DataFrame:
    """Left join to a dimension whose key must be unique."""
    one = unique_by(dim, keys, any_match)
    rest = [c for c in one.columns if c not in keys]
    joined = fact.alias("l").join(one.alias("r"), on_keys(keys, null_safe=null_safe), "left")
    return joined.select("l.*", *[F.col(f"r.{c}") for c in rest])


def lookup_roles(fact: DataFrame, dim: DataFrame, key: str, roles: dict[str, str]) -> DataFrame:
    """Join the same dimension once per role column; its columns get the role's prefix."""
    rest = [c for c in dim.columns if c != key]
    out = fact
    for column, prefix in roles.items():
        side = dim.select(F.col(key).alias(column), *[F.col(c).alias(f"{prefix}{c}") for c in rest])
        out = lookup(out, side, [column])
    return out


def full_join(left: DataFrame, right: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Full outer join with merged key columns."""
    joined = left.alias("l").join(right.alias("r"), on_keys(keys, null_safe=null_safe), "full")
    merged = [F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in keys]
    return joined.select(
        *merged,
        *[F.col(f"l.{c}") for c in left.columns if c not in keys],
        *[F.col(f"r.{c}") for c in right.columns if c not in keys],
    )


def combine_sources(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Full join of measure tables on the same keys, missing measures 0. One partitioning on the keys serves all."""
    out = sources[0]
    for other in sources[1:]:
        out = full_join(out, other, keys)
    return out.fillna(0, subset=[c for c in out.columns if c not in keys])


def full_join_any(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join that keeps one (the least) right row per key."""
    return full_join(left, unique_by(right, keys, any_match=True), keys)


def both_roles(df: DataFrame, key: str, roles: list[str]) -> DataFrame:
    """One country key becomes origin and host at once (internal displacement)."""
    return df.select(*[F.col(key).alias(r) for r in roles], *[c for c in df.columns if c != key])


def align_series(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Second series beside the first, by date."""
    return lookup(left, right, [date])


def override(base: DataFrame, better: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Values of ``better`` win where it has the key."""
    newer = better.select(*keys, F.col(value).alias("_better"))
    joined = lookup(base, newer, keys)
    return joined.withColumn(value, F.coalesce("_better", F.col(value))).drop("_better")


def subtract_part(df: DataFrame, part: str, rest: str, value: str, label: str = "citizenship", date: str = "date"):
    """Take the series of label ``part`` out of the residual series ``rest``, date by date."""
    own = df.filter(F.col(label) == part).groupBy(date).agg(F.sum(value).alias("_part"))
    joined = df.alias("l").join(own.alias("r"), on_keys([date]), "left").select("l.*", "r._part")
    less = F.when(F.col(label) == rest, F.col(value) - F.coalesce("_part", F.lit(0))).otherwise(F.col(value))
    return joined.withColumn(value, less).drop("_part")


def bind_columns(left: DataFrame, right: DataFrame, position: str) -> DataFrame:
    """Columns of two frames side by side by row position; the longer frame decides the length."""
    return full_join(left, right, [position])


def roll_up(df: DataFrame, dim: DataFrame, label: str, group: str, by: list[str], value: str, rest: str | None = None):
    """Totals by the group of each label. Labels are summed before the join; unknown labels go to ``rest``."""
    small = df.groupBy(*by, label).agg(F.sum(value).alias(value))
    joined = lookup(small, dim.select(label, group), [label])
    named = F.coalesce(group, F.lit(rest)) if rest is not None else F.col(group)
    return joined.withColumn(group, named).groupBy(*by, group).agg(F.sum(value).alias(value))


def mark_events(series: DataFrame, events: DataFrame, date: str = "date") -> DataFrame:
    """Points of a series at the dates of known events, with the event columns."""
    return series.join(events, date)
