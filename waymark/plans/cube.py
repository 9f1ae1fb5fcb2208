"""The month cube: facts reduced once to one row per month and label combination.

Every report sums counts over months, so it gives the same result on the cube as on the facts and reads a table that
no longer grows with the number of events. The cube is a written table (not a cached frame): it survives lost
executors, is shared by jobs, and its year partitions prune.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.sources.delimited import inline_table
from waymark.sources.snapshots import folder_exists, remove_folder, write_table

LABELS = ["citizenship", "component", "demographic", "land_border_region"]


def month_cube(facts: DataFrame, labels: list[str] | None = None, value: str = "encounter_count") -> DataFrame:
    keys = [c for c in (labels or LABELS) if c in facts.columns]
    return facts.groupBy("date", *keys).agg(F.sum(value).alias(value))


def write_month_cube(facts: DataFrame, path: str, labels: list[str] | None = None) -> None:
    write_table(month_cube(facts, labels), path, date="date")


def read_month_cube(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """The stored cube, from a calendar year on."""
    cube = spark.read.parquet(path)
    if since is not None:
        cube = cube.filter(F.col("snapshot_year") >= since)
    return cube.drop("snapshot_year")


#: Folders under the path of a cube that is refreshed by month: its partitions, and what each was made from.
CUBE, MADE_FROM = "cube", "made_from"
MADE_FIELDS = "cube_month string, facts bigint, checksum decimal(38,0)"


def _made_from(facts: DataFrame, data: list[str]) -> dict[str | None, tuple]:
    """Rows and an order-free checksum per month; the driver gets a row per month."""
    mixed = F.xxhash64(F.to_json(F.struct(*sorted(data)))).cast("decimal(20,0)")
    per_month = facts.groupBy("cube_month").agg(F.count(F.lit(1)), F.sum(mixed))
    return {r[0]: (r[1], r[2]) for r in per_month.collect()}


def refresh_month_cube(
    facts: DataFrame, path: str, labels: list[str] | None = None, value: str = "encounter_count", since: dt.date | None = None
) -> list[str | None]:
    """Bring a stored cube up to date with the facts and return the months that were rewritten or removed.

    A month is touched when rows or checksum of its facts differ from those its partition was made from; only touched
    partitions are aggregated and rewritten, one whose facts are gone is removed. ``since`` (the ledger's last date, or
    as far back as a source restates its counts) spares earlier months both the check and the scan. What the partitions
    were made from is recorded after they are written, so an interrupted refresh repeats its months. One writer at a
    time. A change of labels needs a new path. Rows without a date are a month of their own (null).
    """
    spark = facts.sparkSession
    keys = [c for c in (labels or LABELS) if c in facts.columns]
    scope = facts if since is None else facts.filter(F.col("date") >= F.lit(since.replace(day=1)))
    months = scope.select("date", *keys, value, F.date_format("date", "yyyy-MM").alias("cube_month"))
    now = _made_from(months, ["date", *keys, value])
    before: dict[str | None, tuple] = {}
    if folder_exists(spark, f"{path}/{MADE_FROM}"):
        before = {r[0]: (r[1], r[2]) for r in spark.read.schema(MADE_FIELDS).parquet(f"{path}/{MADE_FROM}").collect()}
    first = since and f"{since:%Y-%m}"
    known = {m: made for m, made in before.items() if first is None or (m is not None and m >= first)}
    changed = sorted((m for m in now if now[m] != known.get(m)), key=str)
    gone = sorted((m for m in known if m not in now), key=str)
    if not changed and not gone:
        return []
    if changed:
        dated = [m for m in changed if m is not None]
        touched = F.col("cube_month").isin(dated)
        if dated:  # the span of the months reaches the scan
            low, high = dt.date.fromisoformat(f"{dated[0]}-01"), dt.date.fromisoformat(f"{dated[-1]}-01")
            touched = touched & F.col("date").between(low, F.last_day(F.lit(high)))
        if None in changed:
            touched = touched | F.col("date").isNull()
        cells = months.filter(touched).groupBy("cube_month", "date", *keys).agg(F.sum(value).alias(value))
        writer = cells.hint("rebalance", "cube_month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("cube_month").parquet(f"{path}/{CUBE}")
    for m in gone:
        remove_folder(spark, f"{path}/{CUBE}/cube_month={m or '__HIVE_DEFAULT_PARTITION__'}")
    made = {**{m: v for m, v in before.items() if m not in gone}, **now}
    rows = [(m, *v) for m, v in made.items()]
    inline_table(spark, rows, MADE_FIELDS).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MADE_FROM}")
    return changed + gone


def read_refreshed_cube(spark: SparkSession, path: str, since: dt.date | None = None) -> DataFrame:
    """The cube that ``refresh_month_cube`` keeps, from a month on."""
    cube = spark.read.parquet(f"{path}/{CUBE}")
    if since is not None:
        cube = cube.filter(F.col("cube_month").cast("string") >= f"{since:%Y-%m}")
    return cube.drop("cube_month")
