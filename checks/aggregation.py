"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import (
    CURRENT, NEWER, OLDER, check, enc, flow, months, rounded, table,
)
from waymark.functions import numbers
from waymark.functions.calendar import fiscal_year
from waymark.operators import aggregates as agg
from waymark.operators.order import exact_median
from waymark.operators.reshape import series_array
from waymark.plans.groups import collapse_outside
from waymark.sources.delimited import inline_table

FY = "CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
S = "CAST(sum(encounter_count) AS BIGINT)"


@check(
    "a1_sum_by_keys",
    "enc",
    f"SELECT date, citizenship, component, {S} AS encounter_count FROM enc GROUP BY 1, 2, 3",
)
def a1(spark, d):
    return agg.total(enc(spark, d), ["date", "citizenship", "component"], "encounter_count")


@check(
    "a2_sum_many_columns",
    "flow",
    """SELECT year, coa_iso, CAST(sum(refugees) AS BIGINT) AS refugees, CAST(sum(asylum_seekers) AS BIGINT) AS asylum_seekers,
              CAST(sum(oip) AS BIGINT) AS oip FROM flow GROUP BY 1, 2""",
)
def a2(spark, d):
    return agg.total(flow(spark, d), ["year", "coa_iso"], "refugees", "asylum_seekers", "oip")


@check(
    "a3_null_sums",
    "flow",
    """SELECT coo_iso, coa_iso, CAST(sum(refugees) AS BIGINT) AS skipped,
              CASE WHEN count(refugees) = count(*) THEN CAST(sum(refugees) AS BIGINT) END AS strict FROM flow GROUP BY 1, 2""",
)
def a3(spark, d):
    return flow(spark, d).groupBy("coo_iso", "coa_iso").agg(
        F.sum("refugees").alias("skipped"), numbers.strict_sum("refugees").alias("strict")
    )


@check(
    "a4_conditional_sum_mean",
    "enc",
    f"""WITH m AS (SELECT date, citizenship, {S} AS n FROM enc GROUP BY 1, 2)
       SELECT citizenship, CAST(coalesce(sum(n) FILTER (year(date) = 2001), 0) AS BIGINT) AS ytd,
              round(avg(n) FILTER (year(date) = 2001), 6) AS monthly,
              CAST(coalesce(sum(n) FILTER (year(date) = 2000 AND month(date) <= 8), 0) AS BIGINT) AS same_months FROM m GROUP BY 1""",
)
def a4(spark, d):
    now = F.year("date") == CURRENT
    before = (F.year("date") == CURRENT - 1) & (F.month("date") <= 8)
    rows = months(enc(spark, d), "citizenship").groupBy("citizenship").agg(
        numbers.sum_where("encounter_count", now).alias("ytd"),
        numbers.mean_where("encounter_count", now).alias("monthly"),
        numbers.sum_where("encounter_count", before).alias("same_months"),
    )
    return rounded(rows, "monthly")


@check(
    "a5_value_at_date",
    "enc",
    f"""WITH m AS (SELECT date, citizenship, {S} AS n FROM enc GROUP BY 1, 2)
       SELECT citizenship, max(n) FILTER (date = date '{NEWER}') AS lastm, max(n) FILTER (date = date '{OLDER}') AS last2m,
              arg_max(n, date) FILTER (month(date) = 12) AS last_december FROM m GROUP BY 1""",
)
def a5(spark, d):
    december = F.month("date") == 12
    return months(enc(spark, d), "citizenship").groupBy("citizenship").agg(
        numbers.value_at("encounter_count", F.col("date") == F.lit(NEWER).cast("date")).alias("lastm"),
        numbers.value_at("encounter_count", F.col("date") == F.lit(OLDER).cast("date")).alias("last2m"),
        F.max_by(F.when(december, F.col("encounter_count")), F.when(december, F.col("date"))).alias("last_december"),
    )


@check(
    "a6_series_array",
    "enc",
    f"""WITH m AS (SELECT date, citizenship, {S} AS n FROM enc GROUP BY 1, 2)
       SELECT citizenship, string_agg(CAST(n AS VARCHAR), ',' ORDER BY date) AS series FROM m GROUP BY 1""",
)
def a6(spark, d):
    rows = months(enc(spark, d), "citizenship").groupBy("citizenship").agg(series_array("encounter_count", "date").alias("s"))
    return rows.select("citizenship", F.array_join(F.col("s").cast("array<string>"), ",").alias("series"))


@check(
    "a7_halve_repeats",
    "",
    """SELECT l_orderkey, l_returnflag,
              CASE WHEN count(*) > 1 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / 2 ELSE sum(l_quantity) END AS n
       FROM lineitem GROUP BY 1, 2""",
)
def a7(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("bigint").alias("n"))
    return agg.halve_repeats(rows, ["l_orderkey", "l_returnflag"], "n")


@check(
    "a8_mean_of_months",
    "enc",
    f"""WITH m AS (SELECT date, citizenship, {S} AS n FROM enc GROUP BY 1, 2)
       SELECT citizenship, {FY} AS fiscal_year, round(avg(n), 6) AS encounter_count FROM m GROUP BY 1, 2""",
)
def a8(spark, d):
    return rounded(agg.mean_of_months(enc(spark, d), ["citizenship"], "encounter_count"), "encounter_count")


@check(
    "a9_part_year_average",
    "enc",
    f"""WITH y AS (SELECT {FY} AS fiscal_year, {S} AS n FROM enc GROUP BY 1),
       k AS (SELECT count(DISTINCT date) AS k FROM enc WHERE {FY} = 2001)
       SELECT fiscal_year, n, round(CASE WHEN fiscal_year = 2001 THEN n / k ELSE n / 12 END, 6) AS monthly FROM y, k""",
)
def a9(spark, d):
    e = enc(spark, d)
    seen = e.filter(fiscal_year("date") == CURRENT).agg(F.countDistinct("date")).scalar()
    rows = e.groupBy(fiscal_year("date").alias("fiscal_year")).agg(F.sum("encounter_count").alias("n"))
    return rounded(rows.withColumn("monthly", agg.monthly_average("n", "fiscal_year", CURRENT, seen)), "monthly")


@check(
    "a10_total_row",
    "enc",
    f"""SELECT coalesce(citizenship, 'Total') AS citizenship, {S} AS n, CAST(count(DISTINCT date) AS BIGINT) AS months
       FROM enc GROUP BY GROUPING SETS ((citizenship), ())""",
)
def a10(spark, d):
    m = months(enc(spark, d), "citizenship")
    return agg.with_total_row(m, "citizenship", None, "Total", n=F.sum("encounter_count"), months=F.countDistinct("date"))


@check(
    "a11_subgroup_totals",
    "enc",
    f"""WITH y AS (SELECT year(date) AS y, component, {S} AS n, sum(CASE WHEN demographic = 'HOUSEHOLD' THEN encounter_count ELSE 0 END) AS h
         FROM enc GROUP BY GROUPING SETS ((year(date), component), (year(date))))
       SELECT CAST(y AS INTEGER) AS year, coalesce(component, 'Total') AS component, n, round(CAST(h AS DOUBLE) / n, 6) AS household FROM y""",
)
def a11(spark, d):
    house = F.sum(F.when(F.col("demographic") == "HOUSEHOLD", F.col("encounter_count")).otherwise(0))
    e = enc(spark, d).withColumn("year", F.year("date"))
    total = F.sum("encounter_count")
    rows = agg.with_total_row(e, "component", ["year"], "Total", n=total, household=numbers.ratio(house, total))
    return rounded(rows, "household")


@check(
    "a12_min_max",
    "enc",
    """SELECT citizenship, min(date) AS first, max(date) AS last, min(encounter_count) AS low, max(encounter_count) AS high,
              max(encounter_count) - min(encounter_count) AS spread FROM enc GROUP BY 1""",
)
def a12(spark, d):
    low, high = F.min("encounter_count"), F.max("encounter_count")
    return enc(spark, d).groupBy("citizenship").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), low.alias("low"), high.alias("high"),
        (high - low).alias("spread"),
    )


@check(
    "a13_exact_median",
    "",
    """SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY 1
       UNION ALL SELECT 'all', median(l_extendedprice) FROM lineitem""",
)
def a13(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_median(li, "l_extendedprice", ["l_returnflag"], total="all")


@check("a14_distinct_keys", "enc", "SELECT DISTINCT citizenship, component, land_border_region FROM enc")
def a14(spark, d):
    return enc(spark, d).select("citizenship", "component", "land_border_region").distinct()


@check(
    "a15_nested_aggregation",
    "enc",
    f"""SELECT date, CASE WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_4') THEN citizenship ELSE 'OTHER' END AS citizenship,
              {S} AS encounter_count FROM enc GROUP BY 1, 2""",
)
def a15(spark, d):
    m = months(enc(spark, d), "citizenship")
    return collapse_outside(m, "citizenship", ["NATION_2", "NATION_3", "NATION_4"], ["date"], "encounter_count")


@check(
    "a16_control_total",
    "flow",
    """WITH y AS (SELECT year, CAST(sum(coalesce(refugees, 0) + coalesce(oip, 0)) AS BIGINT) AS fdp FROM flow GROUP BY 1),
       k(year, known) AS (VALUES (1995, 100000), (1996, 170000), (2000, 1))
       SELECT CAST(y.year AS INTEGER) AS year, fdp, CAST(known AS BIGINT) AS known, abs(fdp - known) <= abs(known) * 0.25 AS ok
       FROM y JOIN k ON k.year = y.year""",
)
def a16(spark, d):
    rows = flow(spark, d).fillna(0).withColumn("fdp", F.col("refugees") + F.col("oip"))
    known = inline_table(spark, [(1995, 100000), (1996, 170000), (2000, 1)], "year int, known bigint")
    return agg.control_total(rows, ["year"], "fdp", known, 0.25)
