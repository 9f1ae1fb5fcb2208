"""Report queries on the encounter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import CURRENT, GROUPS, MEXICO, NCA, NEWER, OLDER, check, enc, flow, months, pop, rounded, ship, table
from waymark.session import landed
from waymark.functions.calendar import fiscal_year, parse_fiscal_label
from waymark.operators import aggregates as agg
from waymark.plans import cube, groups, models, pathways, ranking, series
from waymark.session import scratch_dir
from waymark.sources import snapshots
from waymark.sources.delimited import inline_table, unfold_pairs

FY = "CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
S = "CAST(sum(encounter_count) AS BIGINT)"
M = f"SELECT date, citizenship, {S} AS encounter_count FROM enc GROUP BY 1, 2"
T = f"SELECT date, {S} AS encounter_count FROM enc GROUP BY 1"
GROUP = """CASE WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_4') THEN 'NCA'
    WHEN citizenship IN ('NATION_5', 'NATION_6', 'NATION_7', 'NATION_8') THEN 'CHNV'
    WHEN citizenship = 'NATION_9' THEN 'MEXICO' ELSE 'OTHER' END"""
NCA_ONLY = "CASE WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_4') THEN 'NCA' ELSE 'Other' END"
MONTHS = range(1, 8)


@check("d1_country_groups", "enc", f"SELECT date, {GROUP} AS grp, {S} AS encounter_count FROM enc GROUP BY 1, 2")
def d1(spark, d):
    label = groups.group_label("citizenship", GROUPS)
    return enc(spark, d).groupBy("date", label.alias("grp")).agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "d2_collapse_outside",
    "enc",
    f"""SELECT component, CASE WHEN citizenship IN ('NATION_2', 'NATION_9') THEN citizenship ELSE 'OTHER' END AS citizenship,
              {S} AS encounter_count FROM enc GROUP BY 1, 2""",
)
def d2(spark, d):
    return groups.collapse_outside(enc(spark, d), "citizenship", ["NATION_2", MEXICO], ["component"], "encounter_count")


def _small(test, src="enc", where=""):
    return f"""t AS (SELECT citizenship, {S} AS n FROM {src} {where} GROUP BY 1),
      k AS (SELECT citizenship, {test.replace('SHARE', 'CAST(n AS DOUBLE) / (SELECT sum(n) FROM t)')} AS shown FROM t)"""


@check(
    "d3_collapse_small",
    "enc",
    f"""WITH {_small('SHARE > 0.04')},
       k2 AS (SELECT citizenship, round_even(CAST(n AS DOUBLE) / (SELECT sum(n) FROM t), 2) > 0.04 AS shown FROM t),
       k3 AS (SELECT citizenship, CAST(n AS DOUBLE) / (SELECT sum(n) FROM t) >= 0.041 AS shown FROM t)
       SELECT 'above' AS rule, CAST(NULL AS INTEGER) AS year, CASE WHEN shown THEN citizenship ELSE 'Other' END AS citizenship, CAST(sum(n) AS BIGINT) AS n
       FROM t JOIN k USING (citizenship) GROUP BY 3
       UNION ALL SELECT 'at or above', NULL, CASE WHEN shown THEN citizenship ELSE 'OTHER' END, CAST(sum(n) AS BIGINT)
       FROM t JOIN k3 USING (citizenship) GROUP BY 3
       UNION ALL SELECT 'rounded', CAST(year(date) AS INTEGER), CASE WHEN shown THEN citizenship ELSE 'Other' END, {S}
       FROM enc JOIN k2 USING (citizenship) WHERE year(date) >= 2000 GROUP BY 2, 3""",
)
def d3(spark, d):
    e = enc(spark, d)
    a = groups.collapse_small(e, "citizenship", "encounter_count", 0.04)
    b = groups.collapse_small(e, "citizenship", "encounter_count", 0.041, other="OTHER", strict=False)
    late = e.filter(F.year("date") >= 2000).withColumn("year", F.year("date"))
    c = groups.collapse_small(late, "citizenship", "encounter_count", 0.04, by=["year"], digits=2, basis=e)
    none = F.lit(None).cast("int").alias("year")
    rows = a.select(F.lit("above").alias("rule"), none, "citizenship", "encounter_count")
    rows = rows.unionByName(b.select(F.lit("at or above").alias("rule"), none, "citizenship", "encounter_count"))
    rows = rows.unionByName(c.select(F.lit("rounded").alias("rule"), "year", "citizenship", "encounter_count"))
    return rows.withColumnRenamed("encounter_count", "n")


@check(
    "d4_share_area",
    "enc",
    f"""WITH {_small('SHARE >= 0.04')},
       a AS (SELECT CASE WHEN shown THEN citizenship ELSE 'Other' END AS citizenship, CAST(sum(n) AS BIGINT) AS encounter_count
             FROM t JOIN k USING (citizenship) GROUP BY 1)
       SELECT citizenship, encounter_count, round(encounter_count * 100.0::DOUBLE / sum(encounter_count) OVER (), 6) AS share,
              CASE WHEN citizenship <> 'Other' THEN citizenship END AS other,
              CASE WHEN citizenship = 'NATION_9' THEN 'Mexico' WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_4') THEN 'nca' ELSE 'Other' END AS subregion,
              round(sum(encounter_count) OVER (ORDER BY encounter_count DESC, citizenship) * 100.0::DOUBLE / sum(encounter_count) OVER (), 6) AS cumulative_share
       FROM a""",
)
def d4(spark, d):
    totals = groups.collapse_small(enc(spark, d), "citizenship", "encounter_count", 0.04, strict=False)
    rows = groups.share_area(totals, "citizenship", "encounter_count", {"Mexico": [MEXICO], "nca": NCA})
    return rounded(rows, "share", "cumulative_share")


@check(
    "d5_per_capita",
    "enc pop",
    f"""WITH m AS ({M}), g AS (SELECT date, {GROUP} AS grp, sum(encounter_count) AS n FROM enc GROUP BY 1, 2),
       gp AS (SELECT {GROUP} AS grp, sum(pop) AS pop FROM pop GROUP BY 1)
       SELECT m.date, m.citizenship AS label, m.encounter_count, round(encounter_count * 1e5 / nullif(pop, 0), 6) AS rate FROM m LEFT JOIN pop USING (citizenship)
       UNION ALL SELECT date, grp, CAST(n AS BIGINT), round(n * 1e6 / nullif(gp.pop, 0), 6) FROM g LEFT JOIN gp USING (grp)""",
)
def d5(spark, d):
    e, p = enc(spark, d), pop(spark, d)
    one = groups.per_capita(months(e, "citizenship"), p, ["citizenship"], "encounter_count", 1e5, "rate")
    label = groups.group_label("citizenship", GROUPS)
    grouped = months(e.withColumn("grp", label), "grp")
    people = p.groupBy(label.alias("grp")).agg(F.sum("pop").alias("pop"))
    many = groups.per_capita(grouped, people, ["grp"], "encounter_count", 1e6, "rate")
    rows = one.select("date", F.col("citizenship").alias("label"), "encounter_count", "rate")
    return rounded(rows.unionByName(many.select("date", F.col("grp").alias("label"), "encounter_count", "rate")), "rate")


@check(
    "d6_top_other_series",
    "enc",
    f"""WITH k AS (SELECT citizenship, rank() OVER (ORDER BY sum(encounter_count) DESC) AS r FROM enc
         WHERE {FY} = 2000 AND citizenship NOT IN ('NATION_2', 'NATION_3', 'NATION_4', 'NATION_9') GROUP BY 1),
       s AS (SELECT date, citizenship, {S} AS encounter_count FROM enc WHERE citizenship IN (SELECT citizenship FROM k WHERE r <= 5) GROUP BY 1, 2),
       o AS (SELECT citizenship, CAST(dense_rank() OVER (ORDER BY sum(encounter_count) DESC) AS INTEGER) AS citizenship_ord FROM s GROUP BY 1)
       SELECT s.*, o.citizenship_ord FROM s JOIN o USING (citizenship)""",
)
def d6(spark, d):
    e = enc(spark, d)
    return series.top_other_series(e, [*NCA, MEXICO], 5, chosen=fiscal_year("date") == 2000)


@check(
    "d7_demographic_series",
    "enc",
    f"""WITH e AS (SELECT * FROM enc WHERE citizenship IN ('NATION_2', 'NATION_3', 'NATION_4')),
       k AS (SELECT DISTINCT date FROM e), v(demographic, label, label_ord) AS (VALUES ('AUTOMOBILE', 'Accompanied', 1), ('BUILDING', 'Unaccompanied', 2), ('HOUSEHOLD', 'Family Units', 3)
         UNION ALL SELECT DISTINCT demographic, demographic, 4 FROM e WHERE demographic NOT IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD')),
       f AS (SELECT k.date, v.demographic, v.label, v.label_ord, {S.replace('sum(encounter_count)', 'coalesce(sum(encounter_count), 0)')} AS encounter_count
             FROM k CROSS JOIN v LEFT JOIN e ON e.date = k.date AND e.demographic = v.demographic GROUP BY 1, 2, 3, 4)
       SELECT date, demographic, label, encounter_count, CAST(sum(encounter_count) OVER (PARTITION BY date) AS BIGINT) AS summig, CAST(label_ord AS INTEGER) AS label_ord FROM f""",
)
def d7(spark, d):
    names = {"AUTOMOBILE": "Accompanied", "BUILDING": "Unaccompanied", "HOUSEHOLD": "Family Units"}
    return series.demographic_series(enc(spark, d), NCA, names, list(names.values()))


def ranking_sql(year, last, prior, extra="", top=12, both=False):
    keep = "WHERE lastm IS NOT NULL AND last2m IS NOT NULL" if both else ""
    return f"""WITH m AS (SELECT date, citizenship, {year} AS y, {S} AS n FROM enc WHERE {year} >= 1998 GROUP BY 1, 2, 3),
    tm AS (SELECT date, 'Total' AS citizenship, y, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY 1, 3),
    ytd AS (SELECT DISTINCT month(date) AS mo FROM m WHERE y >= 2001),
    a AS (SELECT * FROM m {extra} UNION ALL SELECT * FROM tm),
    c AS (SELECT citizenship, CAST(coalesce(sum(n) FILTER (y = 2001), 0) AS BIGINT) AS encounter, avg(n) FILTER (y = 2001) AS mencounter,
             CAST(coalesce(sum(n) FILTER (y = 2000 AND month(date) IN (SELECT mo FROM ytd)), 0) AS BIGINT) AS ly,
             {last} AS lastm, {prior} AS last2m, string_agg(CAST(n AS VARCHAR), ',' ORDER BY date) AS spark FROM a GROUP BY 1),
    r AS (SELECT *, rank() OVER (ORDER BY encounter DESC) AS r FROM (SELECT * FROM c {keep}) WHERE citizenship <> 'Total'),
    b AS (SELECT citizenship, encounter, mencounter, ly, lastm, last2m, spark FROM r WHERE r <= {top} UNION ALL SELECT * FROM c WHERE citizenship = 'Total')
    SELECT citizenship, encounter, round(mencounter, 6) AS mencounter, lastm,
           round(CAST(lastm - last2m AS DOUBLE) / nullif(last2m, 0), 6) AS pct_change_m,
           round(CAST(encounter - ly AS DOUBLE) / nullif(ly, 0), 6) AS pct_change_y,
           round_even(lastm / mencounter, 1) AS fact, spark FROM b"""


BY_DATE = (f"max(n) FILTER (date = date '{NEWER}')", f"max(n) FILTER (date = date '{OLDER}')")
BY_MONTH = ("arg_max(n, date) FILTER (month(date) = 7)", "arg_max(n, date) FILTER (month(date) = 6)")


def _ranking(df):
    shown = df.withColumn("spark", F.array_join(F.col("spark").cast("array<string>"), ","))
    return rounded(shown, "mencounter", "pct_change_m", "pct_change_y")


@check("d8_ranking_table", "enc", ranking_sql("CAST(year(date) AS INTEGER)", *BY_DATE))
def d8(spark, d):
    return _ranking(ranking.ranking_table(enc(spark, d), current=CURRENT, newer=NEWER, older=OLDER))


@check("d8_ranking_table_fiscal", "enc", ranking_sql(FY, *BY_DATE))
def d8_fiscal(spark, d):
    return _ranking(ranking.ranking_table(enc(spark, d), current=CURRENT, newer=NEWER, older=OLDER, basis="fiscal"))


@check(
    "d8_ranking_table_by_month",
    "enc",
    ranking_sql("CAST(year(date) AS INTEGER)", *BY_MONTH, "WHERE citizenship NOT IN ('NATION_2', 'NATION_9')", 10, True),
)
def d8_month(spark, d):
    return _ranking(
        ranking.ranking_table(
            enc(spark, d), current=CURRENT, newer=NEWER, older=OLDER, top=10, match="month", require_both=True,
            exclude=["NATION_2", MEXICO],
        )
    )


@check("d8_ranking_table_from_cube", "enc", ranking_sql("CAST(year(date) AS INTEGER)", *BY_DATE))
def d8_cube(spark, d):
    path = scratch_dir(spark, "cube")
    cube.write_month_cube(enc(spark, d), path)
    stored = cube.read_month_cube(spark, path, since=CURRENT - 3)
    return _ranking(ranking.ranking_table(stored, current=CURRENT, newer=NEWER, older=OLDER))


@check(
    "s7_cube_refreshed_by_month",
    "enc",
    """SELECT date, citizenship, component, demographic, land_border_region, CAST(sum(encounter_count) AS BIGINT) AS encounter_count
       FROM enc GROUP BY 1, 2, 3, 4, 5""",
)
def s7_cube(spark, d):
    e, path = enc(spark, d), scratch_dir(spark, "cube")
    # the first delivery ends earlier, reports one month wrongly and holds rows that are taken back
    restated = F.date_format("date", "yyyy-MM") == "2001-02"
    first = e.filter(F.col("date") < "2001-05-01").withColumn("encounter_count", F.when(restated, 1).otherwise(F.col("encounter_count")).cast("bigint"))
    taken_back = first.filter(F.col("citizenship") == MEXICO).withColumn("date", F.add_months("date", 400))
    cube.refresh_month_cube(first.unionByName(taken_back), path)
    # the gate says that the source is due; it restates up to a year
    ledger = snapshots.latest_dates({"enc": first})
    due = snapshots.refresh_gate(ledger, snapshots.latest_dates({"enc": e}).withColumnRenamed("latest_date", "new_date"))
    since = due.filter("refresh").select(F.add_months("latest_date", -12)).first()[0]
    cube.refresh_month_cube(e, path, since=since)
    return cube.read_refreshed_cube(spark, path)


@check(
    "d9_ranking_decoration",
    "enc",
    f"""WITH s AS (SELECT citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter FROM enc WHERE year(date) = 2001 GROUP BY 1),
       c AS (SELECT * FROM (SELECT *, rank() OVER (ORDER BY encounter DESC) AS r FROM s) WHERE r <= 12),
       a AS (SELECT CASE WHEN citizenship LIKE '%NATION_9%' THEN 'Nine' ELSE citizenship END AS citizenship, encounter FROM c
             UNION ALL SELECT 'Total', CAST(sum(encounter) AS BIGINT) FROM s),
       k AS (SELECT *, CASE WHEN citizenship = 'Total' THEN -1 ELSE encounter END AS key FROM a)
       SELECT citizenship, encounter, CASE WHEN citizenship <> 'Nine' AND citizenship <> 'Total' THEN 'flag/' || citizenship || '.png'
              WHEN citizenship = 'Total' THEN 'un.png' END AS img,
              CAST(dense_rank() OVER (ORDER BY key DESC) AS INTEGER) AS display_ord FROM k""",
)
def d9(spark, d):
    t = ranking.ranking_table(enc(spark, d), current=CURRENT, newer=NEWER, older=OLDER)
    n = F.col("n_name")
    flags = table(spark, d, "nation").select(n.alias("citizenship"), F.concat(F.lit("flag/"), n, F.lit(".png")).alias("img"))
    flags = flags.unionByName(inline_table(spark, [("Total", "un.png")], "citizenship string, img string"))
    rows = ranking.decorate_ranking(t, flags, {"NATION_9": "Nine"}, last="Total")
    return rows.select("citizenship", "encounter", "img", "display_ord")


@check(
    "d10_latest_vs_previous",
    "enc",
    f"""WITH m AS (SELECT {S.replace('sum(encounter_count)', "sum(encounter_count) FILTER (date = date '2001-06-01')")} AS m1,
                {S.replace('sum(encounter_count)', "sum(encounter_count) FILTER (date = date '2001-07-01')")} AS m2 FROM enc WHERE citizenship = 'NATION_3')
       SELECT m1, m2, m2 - m1 AS diff, round((m2 - m1) * 100.0::DOUBLE / m1, 6) AS pct, round(CAST(m2 AS DOUBLE) / m1, 6) AS fct FROM m""",
)
def d10(spark, d):
    e = enc(spark, d).filter(F.col("citizenship") == "NATION_3")
    return rounded(agg.two_date_difference(e, "encounter_count", NEWER, OLDER), "pct", "fct")


@check(
    "d11_header_indicators",
    "enc",
    f"""WITH m AS ({T}), y AS (SELECT year(date) AS y, {S} AS n FROM enc WHERE month(date) BETWEEN 1 AND 7 GROUP BY 1),
       c AS (SELECT component, {S} AS n FROM enc WHERE date = date '{NEWER}' GROUP BY 1)
       SELECT 'month' AS indicator, strftime(date, '%Y-%m-%d') AS period, encounter_count,
              round(CAST(encounter_count AS DOUBLE) / lag(encounter_count) OVER (ORDER BY date) - 1, 6) AS pct FROM m
       UNION ALL SELECT 'year_to_date', CAST(y AS VARCHAR), n, round(CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY y) - 1, 6) FROM y
       UNION ALL SELECT 'component', component, n, round(CAST(n AS DOUBLE) / lag(n) OVER (ORDER BY component) - 1, 6) FROM c""",
)
def d11(spark, d):
    return rounded(series.header_indicators(enc(spark, d), NEWER, list(MONTHS)), "pct")


@check(
    "d12_component_split",
    "enc",
    f"""SELECT date, {FY} AS fiscal_year, component, {S} AS encounter_count,
              CASE WHEN component IN ('R', 'N') THEN 'Between Ports of Entry' ELSE 'At Ports of Entry' END AS lab2
       FROM enc WHERE {FY} >= 1999 GROUP BY 1, 2, 3""",
)
def d12(spark, d):
    return series.component_split(enc(spark, d), ["R", "N"], 1999)


@check(
    "d13_component_share",
    "enc",
    f"""WITH g AS (SELECT date, {GROUP} AS grp, component, sum(encounter_count) AS n FROM enc GROUP BY 1, 2, 3),
       s AS (SELECT date, grp, component, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY date, grp) AS pct FROM g)
       SELECT date, round(max(pct) FILTER (grp = 'NCA'), 6) AS "NCA", round(max(pct) FILTER (grp = 'CHNV'), 6) AS "CHNV",
              round(max(pct) FILTER (grp = 'MEXICO'), 6) AS "MEXICO", round(max(pct) FILTER (grp = 'OTHER'), 6) AS "OTHER"
       FROM s WHERE component = 'R' GROUP BY date""",
)
def d13(spark, d):
    return rounded(series.component_share(enc(spark, d), GROUPS, "R"), "NCA", "CHNV", "MEXICO", "OTHER")


@check(
    "d14_demographic_share",
    "enc",
    f"""WITH g AS (SELECT date, demographic, {S} AS encounter_count FROM enc GROUP BY 1, 2),
       s AS (SELECT *, round(CAST(encounter_count AS DOUBLE) / sum(encounter_count) OVER (PARTITION BY date), 6) AS freq FROM g)
       SELECT * FROM s WHERE demographic = 'HOUSEHOLD'""",
)
def d14(spark, d):
    return rounded(series.demographic_share(enc(spark, d), "HOUSEHOLD"), "freq")


def _wide_share(period, name):
    return f"""SELECT {period} AS {name}, {S.replace('sum(encounter_count)', f"sum(encounter_count) FILTER ({NCA_ONLY} = 'NCA')")} AS "NCA",
      {S.replace('sum(encounter_count)', f"sum(encounter_count) FILTER ({NCA_ONLY} = 'Other')")} AS "Other",
      round(CAST(sum(encounter_count) FILTER ({NCA_ONLY} = 'NCA') AS DOUBLE) / sum(encounter_count), 6) AS pct FROM enc GROUP BY 1"""


@check("d15_group_share_monthly", "enc", _wide_share("date", "date"))
def d15(spark, d):
    return rounded(series.group_share_wide(enc(spark, d), {"NCA": NCA}, F.col("date"), "date"), "pct")


@check("d15_group_share_fiscal", "enc", _wide_share(FY, "fy"))
def d15_fiscal(spark, d):
    return rounded(series.group_share_wide(enc(spark, d), {"NCA": NCA}, fiscal_year("date"), "fy"), "pct")


@check(
    "d16_two_date_table",
    "enc",
    f"""WITH g AS (SELECT date, CASE WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_4') THEN citizenship ELSE 'Other' END AS citizenship, {S} AS n FROM enc GROUP BY 1, 2),
       s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY date) AS p FROM g)
       SELECT citizenship, CAST(sum(n) FILTER (date = date '1998-06-01') AS BIGINT) AS "encounter_count_1998-06-01",
              CAST(sum(n) FILTER (date = date '2001-06-01') AS BIGINT) AS "encounter_count_2001-06-01",
              round(max(p) FILTER (date = date '1998-06-01'), 6) AS "pct_1998-06-01", round(max(p) FILTER (date = date '2001-06-01'), 6) AS "pct_2001-06-01"
       FROM s WHERE date IN (date '1998-06-01', date '2001-06-01') GROUP BY 1""",
)
def d16(spark, d):
    t = series.two_date_table(enc(spark, d), NCA, ["1998-06-01", "2001-06-01"])
    return t.select(*[F.round(c, 6).alias(c) if c.startswith("pct") else F.col(f"`{c}`") for c in t.columns])


@check(
    "d17_year_comparison",
    "enc",
    f"""WITH y AS (SELECT {FY} AS fiscal_year, {S} AS total, CAST(coalesce(sum(encounter_count) FILTER (month(date) NOT IN (8, 9)), 0) AS BIGINT) AS same_months
         FROM enc GROUP BY 1)
       SELECT fiscal_year, total, same_months, round(CASE WHEN fiscal_year = 2001 THEN total / 11 ELSE total / 12 END, 6) AS mean,
              round(CAST(same_months AS DOUBLE) / (SELECT same_months FROM y WHERE fiscal_year = 2000) - 1, 6) AS change FROM y""",
)
def d17(spark, d):
    rows = series.year_comparison(enc(spark, d), [10, 11, 12, *MONTHS], CURRENT, 11, 2000)
    return rounded(rows, "mean", "change")


@check(
    "d18_long_history",
    "enc ship",
    f"""WITH h AS (SELECT {FY} AS fiscal_year, {S} AS apps FROM ship GROUP BY 1),
       b AS (SELECT {FY} AS fiscal_year, CAST(sum(encounter_count) * 2 AS BIGINT) AS apps FROM ship WHERE {FY} IN (1996, 1997) GROUP BY 1),
       l AS (SELECT {FY} AS fiscal_year, {S} AS apps FROM enc WHERE component <> 'A' GROUP BY 1),
       u AS (SELECT h.fiscal_year, coalesce(b.apps, h.apps) AS apps FROM h LEFT JOIN b USING (fiscal_year) WHERE h.fiscal_year < 1999
             UNION ALL SELECT * FROM l WHERE fiscal_year BETWEEN 1999 AND 2001)
       SELECT CAST(fiscal_year AS BIGINT) AS fiscal_year, apps, round(CASE WHEN fiscal_year = 2001 THEN apps / 11 ELSE apps / 12 END, 6) AS appsm FROM u""",
)
def d18(spark, d):
    def yearly(df, factor=1):
        fy = fiscal_year("date").cast("bigint").alias("fiscal_year")
        return df.groupBy(fy).agg((F.sum("encounter_count") * factor).alias("apps"))

    old = ship(spark, d)
    cell = F.concat("fiscal_year", F.lit(',"'), F.format_number("apps", 0), F.lit('"'))
    line = yearly(old).agg(F.array_join(F.collect_list(cell), ",").alias("text"))
    history = unfold_pairs(line, "text", ("fiscal_year", "apps"))
    better = yearly(old.filter(fiscal_year("date").isin(1996, 1997)), 2)
    live = yearly(enc(spark, d).filter(F.col("component") != "A"))
    return rounded(series.long_history(history, better, live, 1999, CURRENT, 11), "appsm")


@check(
    "d19_long_history_groups",
    "enc ship",
    f"""WITH live AS (SELECT * FROM enc WHERE year(date) >= 1998), cut AS (SELECT min(date) AS d FROM live),
       o AS (SELECT date, CASE WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_9') THEN citizenship ELSE 'OTHER' END AS citizenship, {S} AS n
             FROM ship, cut WHERE date < cut.d GROUP BY 1, 2),
       p AS (SELECT date, {S} AS part FROM ship, cut WHERE date < cut.d AND citizenship = 'NATION_5' GROUP BY 1),
       e AS (SELECT o.date, o.citizenship, CASE WHEN o.citizenship = 'OTHER' THEN o.n - coalesce(p.part, 0) ELSE o.n END AS n FROM o LEFT JOIN p USING (date)
             UNION ALL SELECT date, 'NATION_5', part FROM p UNION ALL SELECT date, citizenship, {S} FROM live GROUP BY 1, 2),
       g AS (SELECT date, {GROUP} AS citizenship, CAST(sum(n) AS BIGINT) AS encounter_count FROM e GROUP BY 1, 2)
       SELECT *, round(CAST(encounter_count AS DOUBLE) / sum(encounter_count) OVER (PARTITION BY date), 6) AS freq FROM g""",
)
def d19(spark, d):
    s = landed(months(ship(spark, d), "citizenship"), "months")  # both old sources are read from it
    label = F.when(F.col("citizenship").isin("NATION_2", "NATION_3", MEXICO), F.col("citizenship")).otherwise("OTHER")
    old = months(s.withColumn("citizenship", label), "citizenship")
    live = enc(spark, d).filter(F.year("date") >= 1998)
    return rounded(series.long_history_groups(old, s, live, "NATION_5", "OTHER", GROUPS), "freq")


@check(
    "d20_yearly_group_share",
    "enc ship",
    f"""WITH a AS (SELECT 'wide' AS source, {FY} AS fiscal_year, {NCA_ONLY} AS g1, encounter_count AS n FROM ship WHERE {FY} <= 1996
         UNION ALL SELECT 'yearly', {FY}, {NCA_ONLY}, encounter_count FROM ship WHERE {FY} IN (1997, 1998)
         UNION ALL SELECT 'live', {FY}, {NCA_ONLY}, encounter_count FROM enc WHERE {FY} >= 1999),
       g AS (SELECT source, fiscal_year, g1, CAST(sum(n) AS BIGINT) AS encounter_count FROM a GROUP BY 1, 2, 3)
       SELECT *, round(CAST(encounter_count AS DOUBLE) / sum(encounter_count) OVER (PARTITION BY source, fiscal_year), 6) AS freq FROM g""",
)
def d20(spark, d):
    fy = fiscal_year("date")
    n = F.col("encounter_count")
    in_nca = F.col("citizenship").isin(NCA)
    s, e = ship(spark, d).withColumn("fy", fy), enc(spark, d).withColumn("fy", fy)
    wide = s.filter("fy <= 1996").groupBy(F.concat(F.lit("FY "), F.col("fy") % 100).alias("label")).agg(
        F.sum(n).alias("total"), F.sum(F.when(in_nca, n)).alias("nca")
    )
    wide = wide.select(
        parse_fiscal_label("label", 1900).alias("fiscal_year"), (F.col("total") - F.col("nca")).alias("Other"),
        F.col("nca").alias("NCA"),
    ).unpivot(["fiscal_year"], ["Other", "NCA"], "g1", "encounter_count")
    group = groups.group_label("citizenship", {"NCA": NCA}, "Other").alias("g1")

    def yearly(df):
        return df.groupBy(F.col("fy").alias("fiscal_year"), group).agg(F.sum(n).alias("encounter_count"))

    sources = {"wide": wide, "yearly": yearly(s.filter("fy in (1997, 1998)")), "live": yearly(e.filter("fy >= 1999"))}
    return rounded(series.yearly_group_share(sources), "freq")


RATES = f"""r AS (SELECT date, CAST(sum(encounter_count) FILTER (component <> 'A') AS DOUBLE) / sum(encounter_count) AS rate FROM enc GROUP BY 1)"""


@check(
    "d31_undetected",
    "enc",
    f"""WITH m AS ({T}), {RATES}, j AS (SELECT {FY} AS fiscal_year, CAST(encounter_count AS DOUBLE) AS a, encounter_count / nullif(rate, 0) - encounter_count AS u
         FROM m LEFT JOIN r USING (date) WHERE {FY} < 2001)
       SELECT fiscal_year, 'apprehensions' AS cat, round(sum(a), 3) AS entry_count FROM j GROUP BY 1
       UNION ALL SELECT fiscal_year, 'undetected', round(sum(u), 3) FROM j GROUP BY 1""",
)
def d31(spark, d):
    e = enc(spark, d)
    found = F.sum(F.when(F.col("component") != "A", F.col("encounter_count")))
    rates = e.groupBy("date").agg((found / F.sum("encounter_count")).alias("rate"))
    return pathways.undetected(months(e), rates, CURRENT).withColumn("entry_count", F.round("entry_count", 3))


@check(
    "d32_growth_table",
    "enc",
    f"""WITH y AS (SELECT citizenship, {S.replace('sum(encounter_count)', 'coalesce(sum(encounter_count) FILTER (' + FY + ' = 1996), 0)')} AS a,
         {S.replace('sum(encounter_count)', 'coalesce(sum(encounter_count) FILTER (' + FY + ' = 1997), 0)')} AS b,
         {S.replace('sum(encounter_count)', 'coalesce(sum(encounter_count) FILTER (' + FY + ' = 2000), 0)')} AS z FROM enc GROUP BY 1),
       k AS (SELECT citizenship, CASE WHEN citizenship = 'NATION_3' THEN b ELSE a END AS f, z, CASE WHEN citizenship = 'NATION_3' THEN 3 ELSE 4 END AS n FROM y)
       SELECT citizenship, nullif(CAST(f AS DOUBLE), 0) AS first_value, nullif(CAST(z AS DOUBLE), 0) AS last_value,
              round(nullif(CAST(z - f AS DOUBLE) / nullif(f, 0), 0), 6) AS pct_change,
              round(nullif(pow(CAST(z AS DOUBLE) / nullif(f, 0), 1.0::DOUBLE / n) - 1, 0), 6) AS cagr FROM k""",
)
def d32(spark, d):
    yearly = enc(spark, d).groupBy("citizenship", fiscal_year("date").alias("fiscal_year"))
    yearly = yearly.agg(F.sum("encounter_count").alias("value"))
    return rounded(pathways.growth_table(yearly, "citizenship", 1996, 2000, {"NATION_3": 1997}), "pct_change", "cagr")


@check(
    "d33_pathway_composite",
    "enc ship flow",
    f"""WITH u AS (
         SELECT {FY} AS fiscal_year, 'CLASS_' || component AS cat, encounter_count AS value FROM enc WHERE {FY} >= 1999
         UNION ALL SELECT {FY}, 'CLASS_A', encounter_count FROM ship WHERE {FY} < 1999
         UNION ALL SELECT fiscal_year, cat, value FROM (VALUES (2000, 'QUOTA', 27400), (2001, 'QUOTA', 31000)) q(fiscal_year, cat, value)
         UNION ALL SELECT {FY}, 'PAROLE', encounter_count FROM enc WHERE demographic = 'HOUSEHOLD'
         UNION ALL SELECT year, 'REFUGEES', refugees FROM flow),
       g AS (SELECT fiscal_year, cat, CAST(sum(value) AS BIGINT) AS value FROM u WHERE fiscal_year >= 1997 GROUP BY 1, 2)
       SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, cat, value, CAST(sum(value) OVER (PARTITION BY fiscal_year) AS BIGINT) AS sval FROM g""",
)
def d33(spark, d):
    e, s, f = enc(spark, d), ship(spark, d), flow(spark, d)
    fy = fiscal_year("date").alias("fiscal_year")
    value = F.col("encounter_count").alias("value")
    live = e.filter(fiscal_year("date") >= 1999).select(fy, F.concat(F.lit("CLASS_"), "component").alias("cat"), value)
    sheets = s.filter(fiscal_year("date") < 1999).select(fy, F.lit("CLASS_A").alias("cat"), value)
    quota = inline_table(spark, [(2000, "QUOTA", 27400), (2001, "QUOTA", 31000)], "fiscal_year int, cat string, value bigint")
    refugees = f.select(F.col("year").alias("fiscal_year"), F.lit("REFUGEES").alias("cat"), F.col("refugees").alias("value"))
    parole = e.filter(F.col("demographic") == "HOUSEHOLD").select("date", value)
    return pathways.pathway_composite([live, sheets, quota, refugees], {"PAROLE": parole}, 1997)


@check(
    "d34_policy_estimate",
    "enc",
    f"""WITH b AS (SELECT min(date) AS a, max(date) AS z FROM enc), s AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS date FROM b)
       SELECT 'policy' AS cat, {FY} AS fiscal_year, CAST(sum(CASE WHEN date < date '1998-01-01' THEN 6050 ELSE 27400 END) AS BIGINT) AS value FROM s GROUP BY 2""",
)
def d34(spark, d):
    bounds = enc(spark, d).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    amount = F.when(F.col("date") < F.lit("1998-01-01").cast("date"), 6050).otherwise(27400)
    return pathways.policy_estimate(bounds, "a", "z", amount, "policy")


@check(
    "d35_deflation",
    "enc",
    f"""WITH m AS ({T}), b AS (SELECT max(encounter_count) AS base FROM m WHERE date = date '1996-01-01')
       SELECT date, encounter_count, round(CAST(encounter_count AS DOUBLE) / base, 6) AS price_index,
              round(80000.0::DOUBLE / (CAST(encounter_count AS DOUBLE) / base), 4) AS worth FROM m, b""",
)
def d35(spark, d):
    rows = pathways.deflate(months(enc(spark, d)), "encounter_count", "1996-01-01", 80000.0)
    return rounded(rows, "price_index").withColumn("worth", F.round("worth", 4))


@check(
    "d36_age_difference",
    "enc pop",
    """WITH a AS (SELECT 'AMERICA' AS name, demographic AS age, encounter_count AS v FROM enc WHERE land_border_region = 'AMERICA'
         UNION ALL SELECT citizenship, demographic, encounter_count FROM enc WHERE citizenship = 'NATION_1'),
       g AS (SELECT name, age, sum(v) AS v FROM a GROUP BY 1, 2), s AS (SELECT name, age, CAST(v AS DOUBLE) / sum(v) OVER (PARTITION BY name) AS p FROM g),
       w AS (SELECT age, max(p) FILTER (name = 'NATION_1') AS pn, max(p) FILTER (name = 'AMERICA') AS pr FROM s GROUP BY 1)
       SELECT age, round(pn, 6) AS pct_name, round(pr, 6) AS pct_region, round((pn - pr) * 100, 6) AS diff_percent,
              abs((pn - pr) * 100) >= 1 AS significant, CASE WHEN abs((pn - pr) * 100) >= 1 THEN round((pn - pr) * 100, 6) END AS diff_significant FROM w""",
)
def d36(spark, d):
    e = enc(spark, d)
    value = F.col("encounter_count").alias("value")
    region = e.select(F.col("land_border_region").alias("name"), F.col("demographic").alias("age"), value)
    one = e.select(F.col("citizenship").alias("name"), F.col("demographic").alias("age"), value)
    rows = pathways.age_difference(region.unionByName(one), "NATION_1", "AMERICA")
    return rounded(rows, "pct_name", "pct_region", "diff_percent", "diff_significant")


@check(
    "d37_regular_irregular",
    "enc ship",
    """WITH i AS (SELECT * FROM ship WHERE citizenship = 'NATION_5')
       SELECT date, 'Regular' AS component, CAST(sum(encounter_count) AS BIGINT) AS count FROM enc
       WHERE citizenship = 'NATION_5' AND component = 'A' AND demographic <> 'BUILDING' AND date >= (SELECT min(date) FROM i) GROUP BY 1
       UNION ALL SELECT date, 'Irregular', CAST(sum(encounter_count) AS BIGINT) FROM i GROUP BY 1""",
)
def d37(spark, d):
    own = F.col("citizenship") == "NATION_5"
    regular = enc(spark, d).filter(own & (F.col("component") == "A") & (F.col("demographic") != "BUILDING"))
    irregular = ship(spark, d).filter(own)
    return series.regular_irregular(
        regular.withColumnRenamed("encounter_count", "count"), irregular.withColumnRenamed("encounter_count", "count")
    )


@check(
    "d38_encounters_returns",
    "enc ship",
    f"""WITH a AS ({T}), b AS (SELECT date, {S} AS returns FROM ship GROUP BY 1)
       SELECT date, 'encounter_count' AS name, encounter_count AS value FROM a
       UNION ALL SELECT a.date, 'returns', b.returns FROM a LEFT JOIN b USING (date)""",
)
def d38(spark, d):
    returns = ship(spark, d).withColumnRenamed("encounter_count", "returns")
    return series.encounters_and_returns(enc(spark, d), returns)


# natural cubic spline by forward elimination and back substitution over the inner years
SPLINE_SQL = """WITH RECURSIVE y AS (SELECT citizenship, CAST(year(date) AS INTEGER) AS year, CAST(sum(encounter_count) AS DOUBLE) AS v FROM enc GROUP BY 1, 2),
  p AS (SELECT citizenship, year - min(year) OVER w AS i, max(year) OVER w - min(year) OVER w AS k, min(year) OVER w AS y0, v FROM y WINDOW w AS (PARTITION BY citizenship)),
  r AS (SELECT *, 6 * (lead(v) OVER w - 2 * v + lag(v) OVER w) AS r FROM p WINDOW w AS (PARTITION BY citizenship ORDER BY i)),
  fwd(citizenship, i, k, c, d) AS (
    SELECT citizenship, i, k, 0.25::DOUBLE, r / 4 FROM r WHERE i = 1 AND k > 1
    UNION ALL SELECT r.citizenship, r.i, r.k, 1 / (4 - f.c), (r.r - f.d) / (4 - f.c) FROM fwd f JOIN r ON r.citizenship = f.citizenship AND r.i = f.i + 1 WHERE r.i < r.k),
  bwd(citizenship, i, m) AS (
    SELECT citizenship, i, d FROM fwd WHERE i = k - 1
    UNION ALL SELECT f.citizenship, f.i, f.d - f.c * b.m FROM bwd b JOIN fwd f ON f.citizenship = b.citizenship AND f.i = b.i - 1),
  q AS (SELECT p.*, coalesce(b.m, 0) AS m FROM p LEFT JOIN bwd b USING (citizenship, i)),
  t AS (SELECT DISTINCT citizenship, k, y0, unnest(generate_series(0, 12 * k)) AS t FROM p),
  u AS (SELECT *, least(t // 12, k - 1) AS i, t / 12.0::DOUBLE - least(t // 12, k - 1) AS b FROM t)
  SELECT u.citizenship, make_date(y0 + t // 12, t % 12 + 1, 1) AS date,
         round((1 - b) * l.v + b * h.v + ((pow(1 - b, 3) - (1 - b)) * l.m + (pow(b, 3) - b) * h.m) / 6, 4) AS rate
  FROM u JOIN (SELECT citizenship, i, v, m FROM q) l ON l.citizenship = u.citizenship AND l.i = u.i
  JOIN (SELECT citizenship, i, v, m FROM q) h ON h.citizenship = u.citizenship AND h.i = u.i + 1"""


def _fit_sql() -> str:
    """Least squares by orthogonalising the six basis columns one after another."""

    def cube(i):
        return f"pow(greatest(x - k{i}, 0), 3)"

    slope = [f"(({cube(i)} - {cube(5)}) / (k5 - k{i}))" for i in range(5)]
    basis = ["1.0::DOUBLE", "x", *[f"({slope[i]} - {slope[4]})" for i in range(4)]]
    cuts = ", ".join(f"quantile_cont(t, {i / 5}) AS c{i}" for i in range(6))
    knots = ", ".join(f"(c{i} - c0) / (c5 - c0) AS k{i}" for i in range(6))
    ctes = [
        "m AS (SELECT date, citizenship, CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1, 2)",
        "d AS (SELECT *, CAST(date - date '1970-01-01' AS DOUBLE) AS t FROM m)",
        f"c AS (SELECT citizenship, {cuts} FROM d GROUP BY 1)",
        f"s AS (SELECT d.*, (t - c0) / (c5 - c0) AS x, {knots} FROM d JOIN c USING (citizenship))",
        f"g0 AS (SELECT citizenship, date, n, CAST(n AS DOUBLE) AS rest, {', '.join(f'{b} AS b{j}' for j, b in enumerate(basis))} FROM s)",
    ]
    for j in range(6):
        later = [f"b{i} - sum(b{i} * b{j}) OVER w / sum(b{j} * b{j}) OVER w * b{j} AS b{i}" for i in range(j + 1, 6)]
        left = f"rest - sum(rest * b{j}) OVER w / sum(b{j} * b{j}) OVER w * b{j} AS rest"
        ctes.append(
            f"g{j + 1} AS (SELECT citizenship, date, n, {', '.join([left, *later])} FROM g{j} WINDOW w AS (PARTITION BY citizenship))"
        )
    return f"WITH {', '.join(ctes)} SELECT citizenship, date, n AS encounter_count, round(n - rest, 2) AS predicted FROM g6"


@check("m1_yearly_to_monthly", "enc", SPLINE_SQL)
def m1(spark, d):
    yearly = enc(spark, d).groupBy("citizenship", F.year("date").alias("year")).agg(F.sum("encounter_count").alias("rate"))
    curve = models.yearly_to_monthly(yearly, "citizenship", "year", "rate")
    return curve.withColumn("rate", F.round("rate", 4))


@check("m2_spline_regression", "enc", _fit_sql())
def m2(spark, d):
    fit = models.spline_regression(months(enc(spark, d), "citizenship"), "citizenship", "encounter_count")
    return fit.withColumn("predicted", F.round("predicted", 2))
