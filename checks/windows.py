"""Shares, changes, running totals, ranks and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import check, date_text, enc, flow, months, rounded, table
from waymark.functions.calendar import fiscal_year
from waymark.operators import aggregates as agg
from waymark.operators import order
from waymark.operators.filters import in_months

FY = "CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
S = "CAST(sum(encounter_count) AS BIGINT)"
M = f"SELECT date, citizenship, {S} AS encounter_count FROM enc GROUP BY 1, 2"
T = f"SELECT date, {S} AS encounter_count FROM enc GROUP BY 1"


@check(
    "w1_share_in_group",
    "enc",
    f"""WITH m AS ({M}) SELECT *, round(CAST(encounter_count AS DOUBLE) / sum(encounter_count) OVER (PARTITION BY date), 6) AS share FROM m""",
)
def w1(spark, d):
    return rounded(agg.share(months(enc(spark, d), "citizenship"), "encounter_count", ["date"]), "share")


@check(
    "w2_share_of_all",
    "enc",
    f"""WITH m AS (SELECT citizenship, {S} AS encounter_count FROM enc GROUP BY 1)
       SELECT *, round(encounter_count * 100.0::DOUBLE / (SELECT sum(encounter_count) FROM m), 6) AS share FROM m""",
)
def w2(spark, d):
    rows = enc(spark, d).groupBy("citizenship")
    return rounded(agg.share(rows.agg(F.sum("encounter_count").alias("encounter_count")), "encounter_count", times=100.0), "share")


@check(
    "w3_group_total_on_rows",
    "enc",
    """SELECT date, citizenship, component, encounter_count, CAST(sum(encounter_count) OVER (PARTITION BY date, citizenship) AS BIGINT) AS month_total
       FROM enc""",
)
def w3(spark, d):
    e = enc(spark, d).select("date", "citizenship", "component", "encounter_count")
    return agg.attach_group(e, ["date", "citizenship"], stored=True, month_total=F.sum("encounter_count"))


@check(
    "w4_period_change",
    "enc",
    f"""WITH m AS ({T}), y AS (SELECT CAST(year(date) AS INTEGER) AS y, {S} AS n FROM enc WHERE month(date) BETWEEN 1 AND 7 GROUP BY 1)
       SELECT 'month' AS grain, strftime(date, '%Y-%m-%d') AS period, encounter_count,
              round(CAST(encounter_count AS DOUBLE) / lag(encounter_count) OVER (ORDER BY date) - 1, 6) AS pct FROM m
       UNION ALL SELECT 'year', CAST(y AS VARCHAR), n, round(CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY y) - 1, 6) FROM y""",
)
def w4(spark, d):
    e = enc(spark, d)
    m = agg.monthly_change(e, "encounter_count").select(F.date_format("date", "yyyy-MM-dd").alias("period"), "encounter_count", "pct")
    y = agg.yearly_change(e.filter(in_months("date", range(1, 8))).withColumn("y", F.year("date")), "encounter_count", "y")
    y = y.select(F.col("y").cast("string").alias("period"), "encounter_count", "pct")
    return rounded(m.withColumn("grain", F.lit("month")).unionByName(y.withColumn("grain", F.lit("year"))), "pct")


@check(
    "w5_index_to_base",
    "enc",
    f"""WITH m AS ({M}), b AS (SELECT citizenship, max(encounter_count) AS base FROM m WHERE date = date '2000-01-01' GROUP BY 1)
       SELECT m.*, round(CAST(encounter_count AS DOUBLE) / base, 6) AS index FROM m LEFT JOIN b USING (citizenship)""",
)
def w5(spark, d):
    base = F.col("date") == F.lit("2000-01-01").cast("date")
    return rounded(agg.index_to_base(months(enc(spark, d), "citizenship"), "encounter_count", base, ["citizenship"]), "index")


@check(
    "w6_ratio_to_peer",
    "flow",
    """WITH g AS (SELECT year, CASE WHEN coa_iso = 'NATION_1' THEN 'HOST' ELSE 'REST' END AS coa_g, CAST(sum(refugees) AS BIGINT) AS n FROM flow GROUP BY 1, 2),
       p AS (SELECT year, max(n) AS peer FROM g WHERE coa_g = 'REST' GROUP BY 1)
       SELECT g.*, round(CAST(peer AS DOUBLE) / n, 6) AS ratio FROM g LEFT JOIN p USING (year)""",
)
def w6(spark, d):
    group = F.when(F.col("coa_iso") == "NATION_1", "HOST").otherwise("REST").alias("coa_g")
    rows = flow(spark, d).groupBy("year", group).agg(F.sum("refugees").alias("n"))
    return rounded(agg.ratio_to_peer(rows, "n", "coa_g", "REST", ["year"]), "ratio")


@check(
    "w7_running_total",
    "enc",
    f"""WITH m AS ({T}) SELECT date, encounter_count, CAST(sum(encounter_count) OVER (PARTITION BY {FY} ORDER BY date) AS BIGINT) AS in_year,
              CAST(sum(encounter_count) OVER (ORDER BY date) AS BIGINT) AS overall FROM m""",
)
def w7(spark, d):
    m = months(enc(spark, d)).withColumn("fy", fiscal_year("date"))
    inside = order.running_total(m, "encounter_count", [F.col("date")], F.year("date"), "in_year", ["fy"])
    return order.running_total(inside, "encounter_count", [F.col("date")], F.year("date"), "overall").drop("fy")


@check(
    "w7_running_total_of_hot_values",
    "",
    """SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (ORDER BY o_orderstatus DESC, o_orderkey) AS BIGINT) AS cents,
              CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_orderkey) AS BIGINT) AS place FROM orders""",
)
def w7_hot(spark, d):
    # three states, of which two hold nearly all orders
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"))
    total = order.running_total_split(o, "c", [F.desc("o_orderstatus"), F.col("o_orderkey")], "cents")
    one, keys = F.lit(1).cast("long"), [F.col("o_orderstatus"), F.col("o_orderkey")]
    return order.running_total_split(total, one, keys, "place", ["o_orderpriority"]).select("o_orderkey", "cents", "place")


@check(
    "w8_latest_per_group",
    "enc",
    f"""WITH m AS ({M}), k AS (SELECT * FROM m)
       SELECT citizenship, max(date) AS date, arg_max(encounter_count, date) AS encounter_count FROM k GROUP BY 1""",
)
def w8(spark, d):
    k = months(enc(spark, d), "citizenship")
    return order.latest_per_group(k, ["citizenship"], ["date"])


@check(
    "w9_at_latest_date",
    "enc",
    f"WITH m AS ({M}) SELECT * FROM m WHERE date = (SELECT max(date) FROM m)",
)
def w9(spark, d):
    return months(order.at_latest(enc(spark, d)), "citizenship")


@check(
    "w10_top_with_ties",
    "",
    """WITH q AS (SELECT l_partkey, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1), r AS (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM q)
       SELECT l_partkey, n, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 12""",
)
def w10(spark, d):


    q = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return order.top_with_ties(q, "n", 12)


@check(
    "w11_first_rows",
    "enc",
    f"WITH m AS ({M}) SELECT * FROM m ORDER BY encounter_count DESC, citizenship, date LIMIT 15",
)
def w11(spark, d):
    m = months(enc(spark, d), "citizenship")
    return order.first_rows(m, [F.desc("encounter_count"), F.asc("citizenship"), F.asc("date")], 15)


@check(
    "w12_order_by_total",
    "enc",
    f"""WITH m AS ({M}), t AS (SELECT citizenship, CAST(dense_rank() OVER (ORDER BY sum(encounter_count) DESC) AS INTEGER) AS ord FROM m GROUP BY 1)
       SELECT m.*, t.ord FROM m JOIN t USING (citizenship)""",
)
def w12(spark, d):
    return order.ranked_labels(months(enc(spark, d), "citizenship"), "citizenship", "encounter_count", "ord")


@check(
    "w13_explicit_order",
    "enc",
    f"""SELECT demographic, {S} AS n, CAST(CASE demographic WHEN 'HOUSEHOLD' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE 4 END AS INTEGER) AS ord
       FROM enc GROUP BY 1""",
)
def w13(spark, d):
    rows = enc(spark, d).groupBy("demographic").agg(F.sum("encounter_count").alias("n"))
    return rows.withColumn("ord", order.by_order("demographic", ["HOUSEHOLD", "BUILDING", "MACHINERY"]))


@check(
    "w14_multi_key_sort",
    "enc",
    f"WITH m AS ({M}) SELECT citizenship, strftime(date, '%Y-%m-%d') AS date, encounter_count FROM m ORDER BY citizenship, date DESC",
)
def w14(spark, d):
    return date_text(months(enc(spark, d), "citizenship")).orderBy("citizenship", F.desc("date"))


@check(
    "w15_latest_two",
    "enc",
    f"""WITH m AS ({T}), r AS (SELECT *, row_number() OVER (ORDER BY date DESC) AS r FROM m)
       SELECT max(date) AS date, max(encounter_count) FILTER (r = 1) AS latest,
              max(encounter_count) FILTER (r = 1) - max(encounter_count) FILTER (r = 2) AS difference FROM r WHERE r <= 2""",
)
def w15(spark, d):
    return agg.latest_two(enc(spark, d), "encounter_count")
