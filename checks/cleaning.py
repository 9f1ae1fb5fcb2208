"""Cleaning projections and scalar functions. Dirty text is made from the clean tables inside each query."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.views import NATIONS, check, enc, flow, months, r6, ship, table
from waymark.functions import calendar as cal
from waymark.functions import labels, numbers, text
from waymark.operators import cleaning as clean
from waymark.operators.aggregates import attach_group
from waymark.operators.order import fill_down
from waymark.operators.reshape import to_wide
from waymark.sources import snapshots
from waymark.sources.delimited import inline_table
from waymark.session import landed

FY = "CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER)"
M = "SELECT date, citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1, 2"


@check(
    "c1_select_rename",
    "enc",
    "SELECT date AS month, citizenship AS origin, encounter_count AS entries FROM enc",
)
def c1(spark, d):
    names = {"date": "month", "citizenship": "origin", "encounter_count": "entries"}
    return clean.rename(enc(spark, d), names, keep_only=True)


@check("c2_rename_positions", "flow", "SELECT year AS yr, coo_iso AS origin, coa_iso AS host, refugees AS n FROM flow")
def c2(spark, d):
    return clean.rename_positions(flow(spark, d), ["yr", "origin", "host", "n"])


RAW_NUM = """raw AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS BIGINT) AS n,
    CASE l_linenumber WHEN 3 THEN 'X' WHEN 5 THEN 'D' WHEN 7 THEN '' WHEN 2 THEN '(' || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || ')'
    ELSE format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) END AS cell FROM lineitem)"""


def raw_num(spark, d):
    n = F.format_number(F.floor("l_extendedprice"), 0)
    line = F.col("l_linenumber")
    cell = F.when(line == 3, "X").when(line == 5, "D").when(line == 7, "")
    cell = cell.when(line == 2, F.concat(F.lit("("), n, F.lit(")"))).otherwise(n)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", cell.alias("cell"))


@check(
    "c3_parse_number",
    "",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE floor(l_extendedprice) END AS value
       FROM lineitem WHERE l_linenumber NOT IN (3, 5)
       UNION ALL SELECT l_orderkey, l_linenumber, NULL FROM lineitem WHERE l_linenumber IN (3, 5)""",
)
def c3(spark, d):
    return raw_num(spark, d).select("l_orderkey", "l_linenumber", numbers.parse_number("cell").alias("value"))


@check(
    "c4_digits_only",
    "",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_linenumber IN (3, 5, 7) THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) END AS value
       FROM lineitem""",
)
def c4(spark, d):
    return raw_num(spark, d).select("l_orderkey", "l_linenumber", numbers.digits_only("cell").alias("value"))


@check(
    "c5_unsuppress",
    "",
    """SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, count(*) AS cells,
              CAST(count(*) - CASE WHEN l_linenumber IN (3, 5, 7) THEN count(*) ELSE 0 END AS BIGINT) AS reported,
              CASE WHEN l_linenumber IN (3, 5, 7) THEN NULL
                   ELSE CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE) END AS total
       FROM lineitem GROUP BY l_linenumber""",
)
def c5(spark, d):
    rows = raw_num(spark, d).withColumn("v", numbers.unsuppress("cell"))
    return rows.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("cells"), F.count("v").alias("reported"), F.sum("v").alias("total")
    )


@check(
    "c6_strip_footnotes",
    "",
    """SELECT n_nationkey, n_name || ' kept' AS bracket, replace(n_name, '_', ' no ') AS suffix FROM nation""",
)
def c6(spark, d):
    n = table(spark, d, "nation")
    noted = F.concat("n_name", F.lit(" kept"), F.lit(" ("), "n_nationkey", F.lit(")"))
    suffix = F.concat(F.replace("n_name", F.lit("_"), F.lit(" no ")), F.lit("_"), F.col("n_nationkey") + 3)
    return n.select(
        "n_nationkey", text.strip_footnotes(noted).alias("bracket"), text.strip_footnotes(suffix).alias("suffix")
    )


@check(
    "c7_drop_footnote_rows",
    "enc",
    f"SELECT {FY} AS fy, CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1",
)
def c7(spark, d):
    years = enc(spark, d).groupBy(cal.fiscal_year("date").alias("fy")).agg(F.sum("encounter_count").alias("n"))
    labelled = years.withColumn("label", F.concat(F.lit("FY "), "fy"))
    notes = years.withColumn("label", F.concat(F.lit("Note: counts of "), "fy", F.lit(" are provisional")))
    return clean.drop_footnote_rows(labelled.unionByName(notes), "label").drop("label")


@check(
    "c8_drop_labels",
    "enc pop",
    f"""WITH m AS ({M}) SELECT date, citizenship, encounter_count FROM m""",
)
def c8(spark, d):
    e = enc(spark, d)
    rows = months(e, "citizenship")
    totals = months(e).withColumn("citizenship", F.lit("Total general"))
    regions = months(e, "land_border_region").withColumn("citizenship", F.concat(F.lit("all_other "), "land_border_region"))
    both = rows.unionByName(totals).unionByName(regions.drop("land_border_region"))
    return clean.drop_labels(both, "citizenship", containing=["all_other"])


RAW_FY_SQL = f"""WITH m AS (SELECT date, citizenship, CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1, 2)
SELECT citizenship, date, CAST({FY} AS VARCHAR) AS fiscal_year, n FROM m"""


def raw_fy(spark, d):
    """Month rows per sheet (country) that name the fiscal year only in its first row."""
    m = months(enc(spark, d), "citizenship")
    fy = cal.fiscal_year("date")
    before = F.lag(fy).over(Window.partitionBy("citizenship").orderBy("date"))
    label = F.when(before.isNull() | (before < fy), fy.cast("string"))
    line = F.months_between("date", F.lit("1990-01-01")).cast("bigint")
    return m.select("citizenship", "date", label.alias("fiscal_year"), line.alias("line"), F.col("encounter_count").alias("n"))


@check(
    "c9_fill_down",
    "enc",
    f"""{RAW_FY_SQL} UNION ALL SELECT citizenship, NULL, CASE WHEN citizenship = 'NATION_3' THEN 'note' END, CAST(count(*) AS BIGINT) FROM m GROUP BY 1""",
)
def c9(spark, d):
    rows = landed(raw_fy(spark, d), "sheet")
    # lines without a number keep what they have
    loose = rows.groupBy("citizenship").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "fiscal_year", F.when(F.col("citizenship") == "NATION_3", "note")
    )
    both = rows.unionByName(loose, allowMissingColumns=True)
    # blocks of 10 lines make the fill cross block borders on this small input
    return fill_down(both, ["fiscal_year"], "line", ["citizenship"], size=10).drop("line")


@check(
    "c10_recode",
    "enc",
    """SELECT CASE WHEN citizenship = 'NATION_10' THEN 'Ten' WHEN citizenship LIKE 'NATION_2%' THEN 'Twenties'
                   ELSE citizenship END AS citizenship,
              CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1""",
)
def c10(spark, d):
    label = clean.recode("citizenship", {"NATION_10": "Ten"}, {"^NATION_2": "Twenties"})
    return enc(spark, d).groupBy(label.alias("citizenship")).agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "c11_standardise_country",
    "enc",
    """SELECT CASE WHEN citizenship = 'NATION_3' THEN 'PERU' WHEN citizenship = 'NATION_4' THEN 'OTHER'
                   WHEN citizenship = 'NATION_5' THEN 'STATELESS' ELSE citizenship END AS canonical,
              CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1""",
)
def c11(spark, d):
    rows = months(enc(spark, d), "citizenship").withColumn(
        "raw", clean.recode("citizenship", {"NATION_3": " Perú", "NATION_4": "Oceanía", "NATION_5": "Apátridas"})
    )
    aliases = inline_table(
        spark,
        [("Peru", "Peru"), ("Oceania", "Other"), ("Apatridas", "Stateless")], "alias string, canonical string"
    )
    named = clean.standardise_country(rows, "raw", aliases, "canonical")
    return named.groupBy("canonical").agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "c12_fold_accents",
    "",
    "SELECT n_nationkey, upper(strip_accents(replace(n_name, 'NATION', 'Nación Ñandú Ç'))) AS folded FROM nation",
)
def c12(spark, d):
    raw = F.replace("n_name", F.lit("NATION"), F.lit("Nación Ñandú Ç"))
    return table(spark, d, "nation").select("n_nationkey", F.upper(text.fold_accents(raw)).alias("folded"))


@check(
    "c13_before_comma",
    "",
    """SELECT n_nationkey, n_name || ', Rep. of' AS greedy, n_name AS first_part, n_name AS plain FROM nation""",
)
def c13(spark, d):
    raw = F.concat("n_name", F.lit(", Rep. of, The"))
    return table(spark, d, "nation").select(
        "n_nationkey",
        text.before_last_comma(raw).alias("greedy"),
        text.before_first_comma(raw).alias("first_part"),
        text.before_last_comma("n_name").alias("plain"),
    )


@check(
    "c14_case_and_blanks",
    "",
    """SELECT p_partkey, list_aggregate(list_transform(
                regexp_extract_all(lower(p_name || '-x (east) o''neil'), '[\\p{L}\\p{N}_'']+|[^\\p{L}\\p{N}_'']+'),
                lambda p: upper(p[1]) || p[2:]), 'string_agg', '') AS title,
              upper(replace(p_name, '_', ' ')) AS spaced, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS padded
       FROM part""",
)
def c14(spark, d):
    raw = F.concat("p_name", F.lit("-x (east) o'neil"))
    return table(spark, d, "part").select(
        "p_partkey",
        text.title_case(raw).alias("title"),
        F.upper(text.underscores_to_blanks("p_name")).alias("spaced"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("padded"),
    )


@check(
    "c15_parse_fiscal_label",
    "enc",
    f"SELECT {FY} AS fiscal_year, CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1",
)
def c15(spark, d):
    e = enc(spark, d).withColumn("fy", cal.fiscal_year("date"))
    short = F.concat(F.lit("FY "), F.lpad((F.col("fy") % 100).cast("string"), 2, "0"))
    label = F.when(F.col("fy") < 2000, short).otherwise(F.concat("fy", F.lit(" (FYTD)")))
    rows = e.groupBy(label.alias("label")).agg(F.sum("encounter_count").alias("n"))
    return rows.select(cal.parse_fiscal_label("label", 1900).alias("fiscal_year"), "n")


@check("c16_fiscal_to_calendar", "enc", "SELECT DISTINCT date, CAST(year(date) AS INTEGER) AS year FROM enc")
def c16(spark, d):
    rows = enc(spark, d).select("date").distinct()
    parts = rows.select(cal.fiscal_year("date").alias("fy"), F.date_format("date", "MMMM").alias("month"))
    number = cal.month_number("month")
    year = cal.calendar_year("fy", number)
    return parts.select(cal.month_start(year, number).alias("date"), year.alias("year"))


@check(
    "c17_fiscal_year",
    "enc",
    f"""SELECT {FY} AS fiscal_year, citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count
        FROM enc GROUP BY 1, 2""",
)
def c17(spark, d):
    rows = enc(spark, d).groupBy(cal.fiscal_year("date").alias("fiscal_year"), "citizenship")
    return rows.agg(F.sum("encounter_count").alias("encounter_count"))


@check("c18_month_text_english", "enc", "SELECT date, count(*) AS n, CAST(4 AS BIGINT) AS forms FROM enc GROUP BY date")
def c18(spark, d):
    e = enc(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    short = F.date_format("date", "MMM")
    known = [F.upper(short), F.date_format("date", "MMMM"), F.concat(F.lower(short), F.lit("22")), F.concat(short, F.lit("."))]
    # words that only start like a month are none
    forms = F.array(*known, F.concat(short, F.lit("ginal")), F.concat(F.date_format("date", "MMMM"), F.lit(" total")))
    rows = e.select(F.year("date").alias("y"), F.explode(forms).alias("month"), "n")
    dated = rows.withColumn("date", cal.parse_month("y", "month")).filter(F.col("date").isNotNull())
    return dated.groupBy("date").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("forms"))


@check("c19_month_text_spanish", "enc", "SELECT DISTINCT date, CAST(month(date) AS INTEGER) AS month FROM enc")
def c19(spark, d):
    rows = enc(spark, d).select("date").distinct()
    spanish = F.get(F.array(*[F.lit(m) for m in cal.SPANISH_MONTHS]), F.month("date") - 1)
    named = rows.select(F.year("date").alias("year"), spanish.alias("mes"))
    return named.select(cal.parse_month("year", "mes").alias("date"), cal.month_number("mes").alias("month"))


@check(
    "c20_period_switch",
    "enc",
    f"""SELECT 'calendar' AS basis, CAST(year(date) AS INTEGER) AS period, CAST(sum(encounter_count) AS BIGINT) AS n
        FROM enc GROUP BY 2 UNION ALL
        SELECT 'fiscal', {FY}, CAST(sum(encounter_count) AS BIGINT) FROM enc GROUP BY 2""",
)
def c20(spark, d):
    m = months(enc(spark, d))
    out = None
    for basis in ("calendar", "fiscal"):
        rows = m.groupBy(cal.period_year("date", basis).alias("period")).agg(F.sum("encounter_count").alias("n"))
        rows = rows.select(F.lit(basis).alias("basis"), "period", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@check(
    "c21_fiscal_month_order",
    "enc",
    """SELECT CAST(month(date) AS INTEGER) AS month,
              CAST(CASE WHEN month(date) >= 10 THEN month(date) - 12 ELSE month(date) END AS INTEGER) AS month_ord,
              CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1, 2""",
)
def c21(spark, d):
    rows = enc(spark, d).groupBy(F.month("date").alias("month")).agg(F.sum("encounter_count").alias("n"))
    return rows.withColumn("month_ord", cal.fiscal_month_order("month"))


@check(
    "c22_date_anchors",
    "enc",
    """WITH a AS (SELECT max(date) AS d2 FROM enc)
       SELECT d2 AS date2, CAST(year(d2) AS INTEGER) AS year2, strftime(d2, '%b') AS month2,
              strftime(d2, '%B') AS month2_long, CAST(d2 - INTERVAL 1 MONTH AS DATE) AS date1,
              CAST(year(d2 - INTERVAL 1 MONTH) AS INTEGER) AS year1, strftime(d2 - INTERVAL 1 MONTH, '%b') AS month1,
              strftime(d2 - INTERVAL 1 MONTH, '%B') AS month1_long, CAST(d2 - INTERVAL 3 YEAR AS DATE) AS date_3_ago
       FROM a""",
)
def c22(spark, d):
    return cal.date_anchors(enc(spark, d).agg(F.max("date").alias("date")))


@check(
    "c23_common_as_of",
    "enc ship",
    "SELECT least((SELECT max(date) FROM enc), (SELECT max(date) FROM ship)) AS date",
)
def c23(spark, d):
    return snapshots.as_of_date(snapshots.latest_dates({"enc": enc(spark, d), "ship": ship(spark, d)}))


@check(
    "c24_month_spine",
    "enc ship",
    """WITH b AS (SELECT 'enc' AS k, min(date) AS a, max(date) AS z FROM enc UNION ALL SELECT 'ship', min(date), max(date) FROM ship)
       SELECT k, 'month' AS step, CAST(unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS DATE) AS date FROM b
       UNION ALL
       SELECT k, 'quarter', CAST(unnest(generate_series(z, a, INTERVAL (-4) MONTH)) AS DATE) FROM b
       UNION ALL
       SELECT k, 'years', CAST(unnest(generate_series(z, a, INTERVAL (-24) MONTH)) AS DATE) FROM b""",
)
def c24(spark, d):
    def bounds(df, k):
        return df.agg(F.min("date").alias("a"), F.max("date").alias("z")).withColumn("k", F.lit(k))

    b = bounds(enc(spark, d), "enc").unionByName(bounds(ship(spark, d), "ship"))
    one = cal.month_spine(b, "a", "z").withColumn("step", F.lit("month"))
    three = cal.anchored_month_steps(b, "a", "z", 3).withColumn("step", F.lit("quarter"))
    years = cal.anchored_year_steps(b, "a", "z", 2).withColumn("step", F.lit("years"))
    return one.unionByName(three).unionByName(years)


@check(
    "c25_null_to_zero",
    "flow",
    """SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) AS refugees, coalesce(asylum_seekers, 0) AS asylum_seekers,
              coalesce(oip, 0) AS oip FROM flow""",
)
def c25(spark, d):
    return clean.null_to_zero(flow(spark, d), ["refugees", "asylum_seekers", "oip"])


@check("c26_drop_nulls", "flow", "SELECT * FROM flow WHERE refugees IS NOT NULL AND oip IS NOT NULL")
def c26(spark, d):
    return clean.drop_nulls(flow(spark, d), ["refugees", "oip"])


@check(
    "c27_zero_to_null",
    "flow",
    """WITH y AS (SELECT coo_iso, coa_iso, CAST(coalesce(sum(CASE WHEN year = 1995 THEN oip END), 0) AS BIGINT) AS a,
                         CAST(coalesce(sum(CASE WHEN year = 2001 THEN oip END), 0) AS BIGINT) AS b FROM flow GROUP BY 1, 2)
       SELECT coo_iso, coa_iso, CAST(nullif(a, 0) AS DOUBLE) AS a, CAST(nullif(b, 0) AS DOUBLE) AS b,
              round(nullif(CAST(b AS DOUBLE) / nullif(a, 0), 0), 6) AS r FROM y""",
)
def c27(spark, d):
    y = flow(spark, d).groupBy("coo_iso", "coa_iso").agg(
        *[numbers.sum_where("oip", F.col("year") == yr).alias(c) for c, yr in (("a", 1995), ("b", 2001))]
    )
    ratio = numbers.zero_to_null(numbers.ratio("b", "a"))
    return y.select(
        "coo_iso", "coa_iso", numbers.zero_to_null("a").alias("a"), numbers.zero_to_null("b").alias("b"), r6(ratio, "r")
    )


@check(
    "c28_drop_zero_columns",
    "flow",
    """SELECT year, CAST(sum(refugees) AS BIGINT) AS refugees, CAST(sum(oip) AS BIGINT) AS oip FROM flow GROUP BY year""",
)
def c28(spark, d):
    rows = flow(spark, d).groupBy("year").agg(
        F.sum("refugees").alias("refugees"),
        F.sum("oip").alias("oip"),
        F.sum(F.when(F.col("coo_iso") == "NOWHERE", F.col("oip"))).alias("stateless"),
    )
    return clean.drop_zero_columns(rows, but=["year"])


@check(
    "c29_split_fields",
    "enc",
    """SELECT CAST(year(date) AS VARCHAR) AS year, citizenship, CAST(CAST(sum(encounter_count) AS BIGINT) AS VARCHAR) AS n
       FROM enc GROUP BY 1, 2""",
)
def c29(spark, d):
    y = enc(spark, d).groupBy(F.year("date").alias("y"), "citizenship").agg(F.sum("encounter_count").alias("n"))
    line = F.concat(F.lit("  "), F.col("y"), F.lit("   filler "), F.col("citizenship"), F.lit("\t-  "), F.col("n"), F.lit(" "))
    return clean.split_fields(y.select(line.alias("text")), "text", {1: "year", 3: "citizenship", 5: "n"})


@check(
    "c30_lines_between",
    "enc",
    """WITH m AS (SELECT citizenship, date, CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1, 2),
       f AS (SELECT citizenship, min(date) AS a FROM m WHERE month(date) = 3 AND year(date) >= 1997 GROUP BY 1),
       t AS (SELECT m.citizenship, min(m.date) AS z FROM m JOIN f USING (citizenship)
             WHERE m.date >= f.a AND month(m.date) = 9 AND year(m.date) >= 1999 GROUP BY 1)
       SELECT m.citizenship, m.date, m.n FROM m JOIN f USING (citizenship) JOIN t USING (citizenship)
       WHERE m.date BETWEEN f.a AND t.z""",
)
def c30(spark, d):
    m = months(enc(spark, d), "citizenship")
    line = F.months_between("date", F.lit("1990-01-01")).cast("bigint")
    rows = m.select("citizenship", "date", line.alias("line"), F.date_format("date", "yyyy MM").alias("text"), F.col("encounter_count").alias("n"))
    start, end = "^(199[7-9]|20..) 03", "^(1999|20..) 09"
    return clean.lines_between(rows, "text", "line", start, end, ["citizenship"]).drop("line", "text")


@check(
    "c31_shift_left",
    "flow",
    """WITH w AS (SELECT year, coo_iso, coa_iso, refugees AS a, asylum_seekers AS b, oip AS c FROM flow)
       SELECT year, coo_iso, coa_iso,
              CASE WHEN a IS NULL THEN coalesce(b, c) ELSE a END AS a,
              CASE WHEN a IS NULL THEN CASE WHEN b IS NULL THEN NULL ELSE c END ELSE b END AS b,
              CASE WHEN a IS NULL THEN NULL ELSE c END AS c FROM w""",
)
def c31(spark, d):
    w = flow(spark, d).toDF("year", "coo_iso", "coa_iso", "a", "b", "c")
    return clean.shift_left(w, ["a", "b", "c"])


@check(
    "c32_column_blocks",
    "enc",
    f"""SELECT date, citizenship, component, CAST(sum(encounter_count) AS BIGINT) AS n,
              CASE WHEN CAST(substr(citizenship, 8) AS INTEGER) < 8 THEN 'early' ELSE 'late' END AS half
        FROM enc GROUP BY 1, 2, 3""",
)
def c32(spark, d):
    parts = ["A", "N", "R"]
    e = enc(spark, d)
    place = 3 + 3 * (F.array_position(F.array(*[F.lit(n) for n in NATIONS]), F.col("citizenship")) - 1)
    place = place + F.array_position(F.array(*[F.lit(p) for p in parts]), F.col("component")) - 1
    header = F.concat("component", F.lit("_"), place)
    names = [f"{p}_{3 + 3 * i + j}" for i in range(len(NATIONS)) for j, p in enumerate(parts)]
    wide = to_wide(e.withColumn("h", header), ["date"], "h", names, "encounter_count")
    long = wide.unpivot(["date"], names, "h", "n").filter(F.col("n").isNotNull())
    long = long.withColumn("position", F.regexp_extract("h", r"_(\d+)$", 1).try_cast("int"))
    return long.select(
        "date",
        clean.block_label("position", NATIONS, 3, 3).alias("citizenship"),
        text.strip_footnotes("h").alias("component"),
        "n",
        clean.range_label("position", [(3, 26, "early"), (27, 77, "late")]).alias("half"),
    )


@check(
    "c33_signed_root",
    "",
    """SELECT c_custkey, round(sign(c_acctbal) * pow(abs(c_acctbal), 1.0 / 3), 6) AS root FROM customer""",
)
def c33(spark, d):
    return table(spark, d, "customer").select("c_custkey", r6(numbers.signed_root("c_acctbal"), "root"))


@check(
    "c34_mirror",
    "enc",
    """SELECT demographic, component, CAST(CASE WHEN component = 'A' THEN -sum(encounter_count) ELSE sum(encounter_count) END AS BIGINT) AS n
       FROM enc GROUP BY demographic, component""",
)
def c34(spark, d):
    rows = enc(spark, d).groupBy("demographic", "component").agg(F.sum("encounter_count").alias("n"))
    return rows.withColumn("n", numbers.mirror("n", F.col("component") == "A"))


@check(
    "c35_unit_labels",
    "enc",
    """WITH y AS (SELECT CAST(year(date) AS INTEGER) AS year, sum(encounter_count)::DOUBLE AS v FROM enc GROUP BY 1),
       t AS (SELECT max(v) AS top, sum(v) AS tot FROM y),
       s AS (SELECT y.*, top, tot, CASE WHEN top >= 1e6 THEN 1e6 WHEN top >= 1e3 THEN 1e3 ELSE 1 END AS div FROM y, t),
       g AS (SELECT *, v / div AS q, pow(10.0, 1 - floor(log10(v / div))) AS p FROM s)
       SELECT year, regexp_replace(CAST(CAST(round_even(q * p, 0) / p AS DECIMAL(30, 10)) AS VARCHAR), '\\.?0+$', '')
              || CASE WHEN v = top THEN CASE WHEN top >= 1e6 THEN 'M' WHEN top >= 1e3 THEN 'K' ELSE '' END ELSE '' END AS label,
              regexp_replace(CAST(CAST(round_even(v / tot * 100, 1) AS DECIMAL(30, 10)) AS VARCHAR), '\\.?0+$', '') || '%' AS pct
       FROM g""",
)
def c35(spark, d):
    rows = enc(spark, d).groupBy(F.year("date").alias("year")).agg(F.sum("encounter_count").cast("double").alias("v"))
    rows = attach_group(rows, [], top=F.max("v"), tot=F.sum("v"))
    return rows.select(
        "year",
        labels.unit_label("v", F.col("top")).alias("label"),
        labels.percent_label(F.col("v") / F.col("tot"), 1).alias("pct"),
    )


@check(
    "c36_part_month",
    "enc",
    """SELECT date, CAST(sum(encounter_count) AS DOUBLE) * CASE WHEN date = date '2001-07-01' THEN 0.5 ELSE 1 END AS n
       FROM enc GROUP BY date""",
)
def c36(spark, d):
    rows = months(enc(spark, d))
    return rows.select("date", clean.part_month(F.col("encounter_count"), "date", "2001-07-01").alias("n"))
