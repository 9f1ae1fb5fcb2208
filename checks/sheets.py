"""Sheet normalisers on wide, dirty sheets that each query makes from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import NATIONS, NCA, check, enc, months
from waymark.functions.calendar import MONTH_PREFIXES, SPANISH_MONTHS, fiscal_year
from waymark.operators.cleaning import NAME_EXACT, NAME_PARTS, block_label, range_label, recode
from waymark.operators.reshape import to_wide
from waymark.session import landed
from waymark.sources import sheets

FY = "CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
S = "CAST(sum(encounter_count) AS BIGINT)"
ENGLISH = [m for m in MONTH_PREFIXES if m not in ("ene", "abr", "ago", "set", "dic")]
FISCAL = [*ENGLISH[9:], *ENGLISH[:9]]


def _line(date="date"):
    return F.months_between(F.trunc(F.col(date), "month"), F.lit("1990-01-01")).cast("bigint") * 2


def _sheet(wide, columns):
    """Month rows as landed: fiscal year only on its first row, counts as grouped text, yearly total rows."""
    rows = wide.withColumn("_fy", fiscal_year("date"))
    first = (F.month("date") == 10) | (F.col("date") == F.lit("1995-01-01").cast("date"))
    label = F.when(first, F.concat("_fy", F.lit(" (FYTD)")))

    def text(c):
        return F.when(F.col(c) < 300, "X").otherwise(F.format_number(c, 0)).alias(c)

    body = rows.select(
        label.alias("fiscal_year"),
        F.date_format("date", "MMMM").alias("month"),
        _line().alias("line"),
        *[text(c) for c in columns],
    )
    sums = rows.groupBy("_fy").agg(F.max("date").alias("_last"), *[F.sum(c).alias(c) for c in columns])
    totals = sums.select(
        F.lit(None).cast("string").alias("fiscal_year"),
        F.lit("Total").alias("month"),
        (_line("_last") + 1).alias("line"),
        *[F.format_number(c, 0).alias(c) for c in columns],
    )
    return body.unionByName(totals)


BLOCK_NAMES = ["Total", *NATIONS]
BLOCKS = [f"{cat}_{3 + 4 * i + j}" for i in range(len(BLOCK_NAMES)) for j, cat in enumerate(["total", "a", "n", "r"])]


def _block_sheet(spark, d):
    own = months(enc(spark, d), "citizenship", "component")
    both = own.select("date", F.explode(F.array("citizenship", F.lit("Total"))).alias("citizenship"), "component", "encounter_count")
    both = both.withColumn("cat", F.explode(F.array(F.lower("component"), F.lit("total"))))
    block = F.array_position(F.array(*[F.lit(n) for n in BLOCK_NAMES]), F.col("citizenship")) - 1
    place = F.array_position(F.array(*[F.lit(c) for c in ["total", "a", "n", "r"]]), F.col("cat")) - 1
    header = F.concat("cat", F.lit("_"), 3 + 4 * block + place)
    wide = to_wide(both.withColumn("h", header), ["date"], "h", BLOCKS, "encounter_count", fill=0)
    return _sheet(wide, BLOCKS)


@check(
    "d39_book_out_sheet",
    "enc",
    f"""SELECT 'citizenship' AS sheet, date, citizenship AS label, lower(component) AS cat, CAST(sum(encounter_count) AS DOUBLE) AS count FROM enc
        GROUP BY 2, 3, 4 HAVING sum(encounter_count) >= 300
        UNION ALL SELECT 'ranges', date, g, cat, sum(count) FROM (
          SELECT date, CASE WHEN CAST(substr(citizenship, 8) AS INTEGER) < 8 THEN 'Single' ELSE 'Family' END AS g, lower(component) AS cat, CAST(sum(encounter_count) AS DOUBLE) AS count
          FROM enc GROUP BY date, citizenship, 3 HAVING sum(encounter_count) >= 300) GROUP BY 2, 3, 4""",
)
def d39(spark, d):
    # unpivoted once; both layouts label the same cells
    cells = landed(sheets.book_out_cells(_block_sheet(spark, d)), "cells")
    one = sheets.book_out_sheet(cells, block_label("position", BLOCK_NAMES, 4, 3), "label", halve=True)
    ranges = range_label("position", [(3, 6, "Total"), (7, 38, "Single"), (39, 106, "Family")])
    two = sheets.book_out_sheet(cells, ranges, "label")
    return one.withColumn("sheet", F.lit("citizenship")).unionByName(two.withColumn("sheet", F.lit("ranges")))


@check(
    "d39_book_out_by_agency",
    "enc",
    """SELECT date, lower(component) AS cat, CAST(sum(encounter_count) AS DOUBLE) AS count FROM enc
       GROUP BY 1, 2 HAVING sum(encounter_count) >= 300""",
)
def d39_agency(spark, d):
    own = months(enc(spark, d), "component").withColumn("cat", F.explode(F.array(F.lower("component"), F.lit("total_encounters"))))
    columns = ["total_encounters_3", "a_4", "n_5", "r_6"]
    place = F.array_position(F.array(*[F.lit(c) for c in ["total_encounters", "a", "n", "r"]]), F.col("cat")) + 2
    wide = to_wide(own.withColumn("h", F.concat("cat", F.lit("_"), place)), ["date"], "h", columns, "encounter_count", fill=0)
    return sheets.book_out_by_agency(sheets.book_out_cells(_sheet(wide, columns)))


@check(
    "d40_agency_sheet",
    "enc",
    f"""SELECT date, CASE WHEN citizenship IN ('NATION_2', 'NATION_3', 'NATION_4') THEN replace(citizenship, '_', ' ') || ' NATIONALS' ELSE 'ALL OTHER COUNTRIES' END AS citizenship,
           {S} AS encounter_count FROM enc GROUP BY 1, 2 HAVING sum(encounter_count) >= 300""",
)
def d40(spark, d):
    e = enc(spark, d)
    label = F.when(F.col("citizenship").isin(NCA), F.concat(F.lower("citizenship"), F.lit("_nationals")))
    m = months(e.withColumn("c", F.coalesce(label, F.lit("all_other_countries"))), "c")
    rows = m.withColumn("c", F.explode(F.array("c", F.lit("total"))))
    columns = [*[f"{n.lower()}_nationals" for n in NCA], "all_other_countries", "total"]
    wide = to_wide(rows, ["date"], "c", columns, "encounter_count", fill=0)
    return sheets.agency_sheet(_sheet(wide, columns), residual=True)


#: First-row labels of the fiscal years: years in other words, one missing, one unreadable, one on a row of its own.
YEAR_LABELS = {1995: "Fiscal Year 1995", 1996: "1996*", 1998: "1998 YTD", 1999: "n/a †", 2001: "2001 (FYTD)"}


@check(
    "d40_year_labels",
    "enc",
    f"SELECT date, lower(component) AS part, {S} AS encounter_count FROM enc GROUP BY 1, 2 HAVING sum(encounter_count) >= 300",
)
def d40_labels(spark, d):
    m = months(enc(spark, d).withColumn("c", F.lower("component")), "c")
    columns = ["a", "n", "r"]
    wide = to_wide(m, ["date"], "c", columns, "encounter_count", fill=0)
    plain = _sheet(wide, columns)
    label = F.create_map(*[F.lit(x) for pair in YEAR_LABELS.items() for x in pair])
    spoken = F.when(F.col("fiscal_year").isNotNull(), F.try_element_at(label, F.substring("fiscal_year", 1, 4).try_cast("int")))
    body = plain.withColumn("fiscal_year", spoken)
    heads = plain.filter("fiscal_year is not null")
    blank = [F.lit(None).cast("string").alias(c) for c in columns]
    # the label of 2000 stands on a row above its first month, a note in the second row of every year
    above = heads.filter("fiscal_year like '2000%'").select(F.lit("FY 2000").alias("fiscal_year"), F.lit("").alias("month"), (F.col("line") * 2 - 1).alias("line"), *blank)
    notes = heads.select(F.lit("Figures of 1994 were revised").alias("fiscal_year"), F.lit(None).cast("string").alias("month"), (F.col("line") * 2 + 1).alias("line"), *blank)
    whole = body.withColumn("line", F.col("line") * 2).unionByName(above).unionByName(notes)
    return sheets.agency_sheet(whole, key="name").select("date", F.lower("name").alias("part"), "encounter_count")


@check(
    "d41_country_month_sheet",
    "enc",
    f"""WITH y AS (SELECT DISTINCT year(date) AS y FROM enc), c AS (SELECT DISTINCT citizenship, year(date) AS y FROM enc),
       g AS (SELECT citizenship, make_date(c.y, m, 1) AS date FROM c CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m))
       SELECT g.citizenship, g.date, CAST(coalesce(sum(encounter_count), 0) AS BIGINT) AS encounter_count
       FROM g LEFT JOIN enc e ON e.citizenship = g.citizenship AND e.date = g.date GROUP BY 1, 2""",
)
def d41(spark, d):
    e = enc(spark, d).withColumns({"year": F.year("date"), "m": F.lower(F.date_format("date", "MMM"))})
    rows = e.select("citizenship", "year", "m", "encounter_count")
    rows = rows.unionByName(rows.withColumn("citizenship", F.lit("Total general")))
    rows = rows.unionByName(e.select(F.lit("América").alias("citizenship"), "year", "m", "encounter_count"))
    wide = to_wide(rows, ["citizenship", "year"], "m", ENGLISH, "encounter_count")
    text = wide.select("citizenship", "year", *[F.format_number(m, 0).alias(m) for m in ENGLISH])
    return sheets.country_month_sheet(text, "citizenship", ENGLISH, "year")


HEADERS = [f"{m}{y % 100:02d}" for y in range(1995, 2002) for m in ENGLISH]


@check(
    "d41_header_years",
    "enc",
    f"""WITH g AS (SELECT citizenship, make_date(y, m, 1) AS date FROM (SELECT DISTINCT citizenship FROM enc)
         CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m) CROSS JOIN (SELECT unnest(generate_series(1995, 2001)) AS y))
       SELECT g.citizenship, g.date, CAST(coalesce(sum(encounter_count), 0) AS BIGINT) AS encounter_count
       FROM g LEFT JOIN enc e ON e.citizenship = g.citizenship AND e.date = g.date GROUP BY 1, 2""",
)
def d41_headers(spark, d):
    m = months(enc(spark, d), "citizenship").withColumn("h", F.lower(F.date_format("date", "MMMyy")))
    wide = to_wide(m, ["citizenship"], "h", HEADERS, "encounter_count")
    text = wide.select("citizenship", *[F.concat(F.format_number(h, 0), F.lit(".0")).alias(h) for h in HEADERS])
    return sheets.country_month_sheet(text, "citizenship", HEADERS)


SPELLED = {"NATION_1": "Brasil", "NATION_2": "Rep. Dominicana", "NATION_3": "Dominicana, Rep.", "NATION_4": "Estados Unidos de América"}


@check(
    "d41_spanish_names",
    "enc",
    """WITH n AS (SELECT CASE citizenship WHEN 'NATION_1' THEN 'Brazil' WHEN 'NATION_2' THEN 'Dominican Republic' WHEN 'NATION_3' THEN 'Dominican Republic'
           WHEN 'NATION_4' THEN 'United States' ELSE citizenship END AS citizenship, date, encounter_count FROM enc),
       c AS (SELECT DISTINCT citizenship, year(date) AS y FROM n),
       g AS (SELECT citizenship, make_date(c.y, m, 1) AS date FROM c CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m))
       SELECT g.citizenship, g.date, CAST(coalesce(sum(encounter_count), 0) AS BIGINT) AS encounter_count
       FROM g LEFT JOIN n ON n.citizenship = g.citizenship AND n.date = g.date GROUP BY 1, 2""",
)
def d41_spanish(spark, d):
    e = enc(spark, d).withColumns({"year": F.year("date"), "m": F.get(F.array(*[F.lit(m) for m in SPANISH_MONTHS]), F.month("date") - 1)})
    rows = e.withColumn("citizenship", recode("citizenship", SPELLED)).select("citizenship", "year", "m", "encounter_count")
    rows = rows.unionByName(rows.withColumn("citizenship", F.lit("Total general")))
    wide = to_wide(rows, ["citizenship", "year"], "m", SPANISH_MONTHS, "encounter_count")
    text = wide.select("citizenship", "year", *[F.format_number(m, 0).alias(m) for m in SPANISH_MONTHS])
    return sheets.country_month_sheet(text, "citizenship", SPANISH_MONTHS, "year", exact=NAME_EXACT, parts=NAME_PARTS)


@check(
    "d42_budget_lines",
    "enc",
    f"""WITH v AS (SELECT land_border_region AS cat, citizenship AS op, {FY} AS year, CAST(sum(encounter_count) AS DOUBLE) AS n FROM enc GROUP BY 1, 2, 3),
       g AS (SELECT cat, op, CAST(unnest(generate_series(1995, 2001)) AS INTEGER) AS year FROM (SELECT DISTINCT cat, op FROM v))
       SELECT cat, op, year, CASE year WHEN 1995 THEN n + 0.5 WHEN 1996 THEN -n WHEN 1997 THEN -n ELSE n END AS value FROM g LEFT JOIN v USING (cat, op, year)""",
)
def d42(spark, d):
    years = list(range(1995, 2002))
    e = enc(spark, d).withColumn("fy", fiscal_year("date"))
    wide = to_wide(e, ["land_border_region", "citizenship"], "fy", years, "encounter_count")

    def cell(y):
        n = F.col(str(y))
        forms = {
            1995: F.concat(F.lit("$"), F.format_number(n + 0.5, 2)),
            1996: F.concat(F.lit("($"), F.format_number(n, 0), F.lit(")")),
            1997: F.concat(F.lit("-"), n.cast("string")),
            1998: F.concat(n.cast("string"), F.lit(".0")),
        }
        return forms.get(y, F.concat(F.lit("$ "), F.format_number(n, 0)))

    lines = wide.select(
        F.col("citizenship").alias("line_item"),
        (F.crc32("land_border_region") * 1000 + 1 + F.regexp_extract("citizenship", r"(\d+)", 1).try_cast("bigint")).alias("line"),
        *[cell(y).alias(f"fy_{y}") for y in years],
    )
    blank = [F.lit(None).cast("string").alias(f"fy_{y}") for y in years]
    heads = e.select("land_border_region").distinct()
    parents = heads.select(F.col("land_border_region").alias("line_item"), (F.crc32("land_border_region") * 1000).alias("line"), *blank)
    empty = heads.select(
        F.lit("unfunded").alias("line_item"), (F.crc32("land_border_region") * 1000 + 900).alias("line"),
        *[F.lit("$0").alias(f"fy_{y}") for y in years],
    )
    sheet = lines.unionByName(parents).unionByName(empty)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return sheets.budget_lines(sheet, "line_item", names)


@check(
    "d43_admissions_sheet",
    "enc",
    f"""WITH c AS (SELECT DISTINCT citizenship, {FY} AS y FROM enc), g AS (SELECT citizenship, make_date(CASE WHEN m > 9 THEN y - 1 ELSE y END, m, 1) AS date FROM c CROSS JOIN (SELECT unnest(generate_series(1, 12))::INTEGER AS m))
       SELECT g.date, g.citizenship AS country, {S} AS value FROM g LEFT JOIN enc e ON e.citizenship = g.citizenship AND e.date = g.date GROUP BY 1, 2""",
)
def d43(spark, d):
    m = months(enc(spark, d), "citizenship").withColumns(
        {"year": F.format_number(fiscal_year("date"), 0), "m": F.lower(F.date_format("date", "MMM"))}
    )
    wide = to_wide(m, ["year", "citizenship"], "m", FISCAL, "encounter_count")
    text = wide.select("year", F.col("citizenship").alias("country"), *[F.format_number(c, 0).alias(c) for c in FISCAL])
    return sheets.admissions_sheet(text, FISCAL, label="country")
