"""Wide and long layouts, and full grids. Pivots take their value list, so they cost no extra job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.session import landed

#: Spine values of a grid that travel in one row.
SPINE_BLOCK = 1_000


def to_long(df: DataFrame, ids: list[str], columns: list[str] | None, name: str, value: str) -> DataFrame:
    columns = columns or [c for c in df.columns if c not in ids]
    return df.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, ids: list[str], key: str, values: list, measure: str, fill=None) -> DataFrame:
    wide = df.groupBy(*ids).pivot(key, values).agg(F.sum(measure))
    return wide if fill is None else wide.fillna(fill, subset=[str(v) for v in values])


def to_wide_many(df: DataFrame, ids: list[str], key: str, values: list, measures: list[str]) -> DataFrame:
    """Several measures per key, named ``measure_key``."""
    cells = [
        F.sum(F.when(F.col(key).eqNullSafe(F.lit(v)), F.col(m))).alias(f"{m}_{v}") for m in measures for v in values
    ]
    return df.groupBy(*ids).agg(*cells)


def densify(df: DataFrame, ids: list[str], key: str, values: list[str], measure: str) -> DataFrame:
    """One row per id and listed label, absent cells 0."""
    wide = to_wide(df, ids, key, values, measure, fill=0)
    return to_long(wide, ids, list(values), key, measure)


def full_grid(df: DataFrame, spine: str, label: str, measure: str, fill=0, null_again: str | None = None) -> DataFrame:
    """One row per distinct ``spine`` value and label, absent cells ``fill``.

    The totals are landed once. The distinct spine values lie in blocks of about ``SPINE_BLOCK`` (by hash), one row each;
    every label meets the blocks by number and explodes them, so no row holds all values, whatever their number.
    ``null_again`` names a label whose zeros mean "not reported". A null spine value has no row; a null label has its
    rows. Runs jobs at once.
    """
    have = landed(df.groupBy(spine, label).agg(F.sum(measure).alias(measure)), "cells")
    values = have.select(spine).filter(F.col(spine).isNotNull()).distinct()
    blocks = values.count() // SPINE_BLOCK + 1
    place = F.pmod(F.xxhash64(spine), F.lit(blocks)).cast("int")
    cut = landed(values.groupBy(place.alias("_block")).agg(F.collect_list(spine).alias("_values")), "spine")
    labels = have.select(label).distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    grid = labels.join(cut, "_block").select(label, F.explode("_values").alias(spine))
    on = F.col(f"g.{spine}").eqNullSafe(F.col(f"h.{spine}")) & F.col(f"g.{label}").eqNullSafe(F.col(f"h.{label}"))
    filled = F.coalesce(F.col(f"h.{measure}"), F.lit(fill))
    out = grid.alias("g").join(have.alias("h"), on, "left").select(f"g.{spine}", f"g.{label}", filled.alias(measure))
    if null_again is not None:
        hide = (F.col(label) == null_again) & (F.col(measure) == fill)
        out = out.withColumn(measure, F.when(hide, None).otherwise(F.col(measure)))
    return out


def stack_tagged(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union by name with the frame's key as a column; columns missing from a frame are null."""
    out = None
    for label, frame in frames.items():
        tagged = frame.withColumn(tag, F.lit(label))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def stack(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def series_array(value, date) -> Column:
    """Values of a group as one array in date order. The group must hold one row per month."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(date), F.col(value))))
    return F.transform(pairs, lambda p: p[value])
