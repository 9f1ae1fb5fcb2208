"""Filters, reshaping, joins, set operations and splices."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import CURRENT, MEXICO, NCA, check, country, enc, flow, internal, months, pop, ship, table
from waymark.session import landed
from waymark.functions.calendar import fiscal_year
from waymark.operators import filters, joins, reshape, splice
from waymark.operators.order import ordinal, top_with_ties
from waymark.sources.delimited import inline_table

M = "SELECT date, citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1, 2"
SM = "SELECT date, citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM ship GROUP BY 1, 2"
T = "SELECT date, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1"


# filters


@check(
    "f1_filters",
    "enc",
    """SELECT date, citizenship, component, encounter_count FROM enc
       WHERE date BETWEEN date '1999-01-01' AND date '2000-06-01' AND citizenship IN ('NATION_2', 'NATION_9')
         AND (component = 'A' OR encounter_count > 30)""",
)
def f1(spark, d):
    keep = F.col("date").between(F.lit("1999-01-01").cast("date"), F.lit("2000-06-01").cast("date"))
    keep = keep & F.col("citizenship").isin("NATION_2", MEXICO)
    keep = keep & ((F.col("component") == "A") | (F.col("encounter_count") > 30))
    return enc(spark, d).filter(keep).select("date", "citizenship", "component", "encounter_count")


@check(
    "f2_not_in",
    "enc",
    """WITH e AS (SELECT CASE WHEN component = 'N' THEN NULL ELSE citizenship END AS citizenship, encounter_count FROM enc)
       SELECT citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM e
       WHERE citizenship IS NULL OR citizenship NOT IN ('NATION_2', 'NATION_3', 'NATION_4') GROUP BY 1""",
)
def f2(spark, d):
    some = F.when(F.col("component") != "N", F.col("citizenship")).alias("citizenship")
    e = enc(spark, d).select(some, "encounter_count").filter(filters.not_in("citizenship", NCA))
    return e.groupBy("citizenship").agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "f3_year_to_date_months",
    "enc",
    """SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc
       WHERE month(date) BETWEEN 1 AND 7 GROUP BY 1""",
)
def f3(spark, d):
    e = enc(spark, d).filter(filters.in_months("date", range(1, 8)))
    return e.groupBy(F.year("date").alias("year")).agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "f4_same_months_as_current",
    "enc",
    """SELECT CAST(year(date) AS INTEGER) AS year, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc
       WHERE month(date) IN (SELECT DISTINCT month(date) FROM enc WHERE year(date) >= 2001) GROUP BY 1""",
)
def f4(spark, d):
    e = filters.year_to_date(enc(spark, d), F.year("date"), CURRENT)
    return e.groupBy(F.year("date").alias("year")).agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "f5_text_match",
    "enc",
    """SELECT citizenship, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc
       WHERE regexp_matches(citizenship, 'NATION_[12]$|_2[0-9]') AND NOT demographic LIKE '%BUILD%' GROUP BY 1""",
)
def f5(spark, d):
    keep = F.col("citizenship").rlike("NATION_[12]$|_2[0-9]") & ~F.col("demographic").contains("BUILD")
    return enc(spark, d).filter(keep).groupBy("citizenship").agg(F.sum("encounter_count").alias("encounter_count"))


@check(
    "f6_data_derived_cutoff",
    "enc ship",
    """SELECT 'before' AS side, date, CAST(sum(encounter_count) AS BIGINT) AS n FROM enc
       WHERE date < (SELECT min(date) FROM ship WHERE year(date) >= 1998) GROUP BY 2
       UNION ALL SELECT 'after', date, CAST(sum(encounter_count) AS BIGINT) FROM ship
       WHERE date > (SELECT max(date) FROM enc) GROUP BY 2""",
)
def f6(spark, d):
    e, s = enc(spark, d), ship(spark, d)
    a = months(filters.before_first(e, s.filter(F.year("date") >= 1998))).withColumn("side", F.lit("before"))
    b = months(filters.after_last(s, e)).withColumn("side", F.lit("after"))
    return a.unionByName(b).withColumnRenamed("encounter_count", "n")


@check(
    "f7_keep_groups",
    "enc",
    """SELECT citizenship, component, date, encounter_count FROM enc WHERE (citizenship, component) IN
       (SELECT (citizenship, component) FROM enc GROUP BY citizenship, component HAVING sum(encounter_count) > 20000)""",
)
def f7(spark, d):
    kept = filters.keep_groups(enc(spark, d), ["citizenship", "component"], "encounter_count", 20000, stored=True)
    return kept.select("citizenship", "component", "date", "encounter_count")


@check("f8_across_borders", "flow", "SELECT * FROM flow WHERE coo_iso <> coa_iso")
def f8(spark, d):
    return filters.across_borders(flow(spark, d))


@check(
    "f9_members",
    "flow country",
    """SELECT * FROM flow WHERE coo_iso IN (SELECT iso_code FROM country WHERE region = 'AMERICA')
       AND coa_iso IN (SELECT iso_code FROM country WHERE region = 'AMERICA')""",
)
def f9(spark, d):
    region = country(spark, d).filter(F.col("region") == "AMERICA")
    return filters.members(filters.members(flow(spark, d), "coo_iso", region, "iso_code"), "coa_iso", region, "iso_code")


# reshape


@check(
    "r1_to_long",
    "flow",
    """SELECT year, coo_iso, coa_iso, 'refugees' AS measure, refugees AS value FROM flow
       UNION ALL SELECT year, coo_iso, coa_iso, 'asylum_seekers', asylum_seekers FROM flow
       UNION ALL SELECT year, coo_iso, coa_iso, 'oip', oip FROM flow""",
)
def r1(spark, d):
    return reshape.to_long(flow(spark, d), ["year", "coo_iso", "coa_iso"], None, "measure", "value")


WIDE_SQL = """SELECT date, CAST(sum(CASE WHEN component = 'A' THEN encounter_count END) AS BIGINT) AS "A",
   CAST(sum(CASE WHEN component = 'N' THEN encounter_count END) AS BIGINT) AS "N",
   CAST(sum(CASE WHEN component = 'R' THEN encounter_count END) AS BIGINT) AS "R" FROM enc GROUP BY date"""


@check("r2_to_wide", "enc", WIDE_SQL)
def r2(spark, d):
    return reshape.to_wide(enc(spark, d), ["date"], "component", ["A", "N", "R"], "encounter_count")


@check(
    "r3_to_wide_many",
    "enc",
    """SELECT date, CAST(sum(CASE WHEN component = 'A' THEN encounter_count END) AS BIGINT) AS "n_A",
              CAST(sum(CASE WHEN component = 'R' THEN encounter_count END) AS BIGINT) AS "n_R",
              CAST(sum(CASE WHEN component = 'A' THEN 1 END) AS BIGINT) AS "k_A",
              CAST(sum(CASE WHEN component = 'R' THEN 1 END) AS BIGINT) AS "k_R" FROM enc GROUP BY date""",
)
def r3(spark, d):
    rows = enc(spark, d).select("date", "component", F.col("encounter_count").alias("n"), F.lit(1).cast("bigint").alias("k"))
    return reshape.to_wide_many(rows, ["date"], "component", ["A", "R"], ["n", "k"])


@check(
    "r4_densify",
    "enc",
    """WITH e AS (SELECT * FROM enc WHERE NOT (demographic = 'BUILDING' AND month(date) % 3 = 1)),
       k AS (SELECT DISTINCT date, citizenship FROM e), v(demographic) AS (SELECT DISTINCT demographic FROM enc UNION ALL SELECT 'ABSENT')
       SELECT k.date, k.citizenship, v.demographic, CAST(coalesce(sum(e.encounter_count), 0) AS BIGINT) AS encounter_count
       FROM k CROSS JOIN v LEFT JOIN e ON e.date = k.date AND e.citizenship = k.citizenship AND e.demographic = v.demographic GROUP BY 1, 2, 3""",
)
def r4(spark, d):
    # gaps: whole cells are missing
    e = enc(spark, d).filter(~((F.col("demographic") == "BUILDING") & (F.month("date") % 3 == 1)))
    labels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "ABSENT"]
    return reshape.densify(e, ["date", "citizenship"], "demographic", labels, "encounter_count")


@check(
    "r5_full_grid",
    "enc",
    """WITH e AS (SELECT * FROM enc WHERE NOT (CAST(substr(citizenship, 8) AS INTEGER) % 4 = 1 AND month(date) % 3 = 0)),
       g AS (SELECT * FROM (SELECT DISTINCT date FROM e) CROSS JOIN (SELECT DISTINCT citizenship FROM e)),
       f AS (SELECT g.date, g.citizenship, CAST(coalesce(sum(encounter_count), 0) AS BIGINT) AS n
             FROM g LEFT JOIN e ON e.date = g.date AND e.citizenship = g.citizenship GROUP BY 1, 2)
       SELECT date, citizenship, CASE WHEN citizenship = 'NATION_9' AND n = 0 THEN NULL ELSE n END AS encounter_count FROM f""",
)
def r5(spark, d):
    number = F.substring("citizenship", 8, 9).try_cast("int")
    e = enc(spark, d).filter(~((number % 4 == 1) & (F.month("date") % 3 == 0)))  # gaps: whole cells are missing
    return reshape.full_grid(e, "date", "citizenship", "encounter_count", 0, null_again=MEXICO)


# joins


@check(
    "j1_join_population",
    "enc pop",
    f"WITH m AS ({M}) SELECT m.*, p.region, p.pop FROM m LEFT JOIN pop p USING (citizenship)",
)
def j1(spark, d):
    return joins.lookup(months(enc(spark, d), "citizenship"), pop(spark, d), ["citizenship"])


@check(
    "j2_join_flags",
    "enc",
    f"""WITH m AS ({M}), f AS (SELECT n_name AS citizenship, 'flag/' || n_nationkey || '.png' AS img FROM nation WHERE n_regionkey <> 2)
        SELECT m.*, f.img FROM m LEFT JOIN f USING (citizenship)""",
)
def j2(spark, d):
    image = F.concat(F.lit("flag/"), "n_nationkey", F.lit(".png"))
    flags = table(spark, d, "nation").filter(F.col("n_regionkey") != 2)
    flags = flags.select(F.col("n_name").alias("citizenship"), image.alias("img"))
    return joins.lookup(months(enc(spark, d), "citizenship"), flags, ["citizenship"])


@check(
    "j3_join_two_roles",
    "flow country",
    """SELECT f.year, f.coo_iso, f.coa_iso, f.oip, a.region AS coo_region, b.region AS coa_region FROM flow f
       LEFT JOIN country a ON a.iso_code = f.coo_iso LEFT JOIN country b ON b.iso_code = f.coa_iso""",
)
def j3(spark, d):
    f = flow(spark, d).select("year", "coo_iso", "coa_iso", "oip")
    return joins.lookup_roles(f, country(spark, d), "iso_code", {"coo_iso": "coo_", "coa_iso": "coa_"})


@check(
    "j4_combine_sources",
    "flow",
    """WITH a AS (SELECT year, coo_iso, coa_iso, refugees FROM flow WHERE year <= 1999),
       b AS (SELECT year, coo_iso, coa_iso, asylum_seekers FROM flow WHERE year >= 1997),
       c AS (SELECT year, coo_iso, coa_iso, oip FROM flow WHERE coo_iso = coa_iso)
       SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) AS refugees, coalesce(asylum_seekers, 0) AS asylum_seekers,
              coalesce(oip, 0) AS oip
       FROM a FULL JOIN b USING (year, coo_iso, coa_iso) FULL JOIN c USING (year, coo_iso, coa_iso)""",
)
def j4(spark, d):
    f = flow(spark, d)
    a = f.filter("year <= 1999").select("year", "coo_iso", "coa_iso", "refugees")
    b = f.filter("year >= 1997").select("year", "coo_iso", "coa_iso", "asylum_seekers")
    c = f.filter("coo_iso = coa_iso").select("year", "coo_iso", "coa_iso", "oip")
    return joins.combine_sources([a, b, c], ["year", "coo_iso", "coa_iso"])


@check(
    "j5_full_join_any",
    "flow",
    """WITH a AS (SELECT year, coo_iso, CAST(sum(refugees) AS BIGINT) AS refugees FROM flow WHERE year >= 1998 GROUP BY 1, 2),
       b AS (SELECT year, coo_iso, min(oip) AS oip FROM flow WHERE year <= 1999 AND oip > 300 GROUP BY 1, 2)
       SELECT year, coo_iso, refugees, oip FROM a FULL JOIN b USING (year, coo_iso)""",
)
def j5(spark, d):
    f = flow(spark, d)
    a = f.filter("year >= 1998").groupBy("year", "coo_iso").agg(F.sum("refugees").alias("refugees"))
    b = f.filter("year <= 1999 and oip > 300").select("year", "coo_iso", "oip")
    return joins.full_join_any(a, b, ["year", "coo_iso"])


@check(
    "j6_both_roles",
    "flow internal",
    """SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) AS refugees,
              coalesce(conflict_internal_displacements, 0) AS conflict_internal_displacements
       FROM (SELECT year, coo_iso, coa_iso, refugees FROM flow)
       FULL JOIN (SELECT year, iso3 AS coo_iso, iso3 AS coa_iso, conflict_internal_displacements FROM internal)
       USING (year, coo_iso, coa_iso)""",
)
def j6(spark, d):
    own = joins.both_roles(
        internal(spark, d).select("year", "iso3", "conflict_internal_displacements"), "iso3", ["coo_iso", "coa_iso"]
    )
    f = flow(spark, d).select("year", "coo_iso", "coa_iso", "refugees")
    return joins.combine_sources([f, own], ["year", "coo_iso", "coa_iso"])


@check(
    "j7_align_series",
    "enc ship",
    f"""WITH a AS ({T}), b AS (SELECT date, CAST(sum(encounter_count) AS BIGINT) AS returns FROM ship GROUP BY 1)
        SELECT a.date, a.encounter_count, b.returns FROM a LEFT JOIN b USING (date)""",
)
def j7(spark, d):
    s = months(ship(spark, d)).withColumnRenamed("encounter_count", "returns")
    return joins.align_series(months(enc(spark, d)), s)


@check(
    "j8_subtract_part",
    "enc",
    """WITH m AS (SELECT date, CASE WHEN citizenship IN ('NATION_2', 'NATION_3') THEN citizenship ELSE 'OTHER' END AS citizenship,
                         CAST(sum(encounter_count) AS BIGINT) AS n FROM enc GROUP BY 1, 2)
       SELECT m.date, m.citizenship, CASE WHEN m.citizenship = 'OTHER' THEN m.n - coalesce(p.n, 0) ELSE m.n END AS encounter_count
       FROM m LEFT JOIN (SELECT date, n FROM m WHERE citizenship = 'NATION_2') p USING (date)""",
)
def j8(spark, d):
    label = F.when(F.col("citizenship").isin("NATION_2", "NATION_3"), F.col("citizenship")).otherwise("OTHER")
    m = months(enc(spark, d).withColumn("citizenship", label), "citizenship")
    return joins.subtract_part(m, "NATION_2", "OTHER", "encounter_count")


@check(
    "j9_override",
    "enc ship",
    f"""WITH a AS ({M}), b AS ({SM})
        SELECT a.date, a.citizenship, coalesce(b.encounter_count, a.encounter_count) AS encounter_count
        FROM a LEFT JOIN (SELECT * FROM b WHERE year(date) = 1998) b USING (date, citizenship)""",
)
def j9(spark, d):
    better = months(ship(spark, d).filter(F.year("date") == 1998), "citizenship")
    return joins.override(months(enc(spark, d), "citizenship"), better, ["date", "citizenship"], "encounter_count")


TOP5 = """SELECT citizenship FROM (SELECT citizenship, rank() OVER (ORDER BY sum(encounter_count) DESC) AS r FROM enc GROUP BY 1) WHERE r <= 5"""


@check(
    "j10_semi_derived_set",
    "enc",
    f"WITH t AS ({TOP5}), m AS ({M}) SELECT * FROM m WHERE citizenship IN (SELECT citizenship FROM t)",
)
def j10(spark, d):
    m = landed(months(enc(spark, d), "citizenship"), "months")  # the facts are read once and shrink before the join
    best = top_with_ties(m.groupBy("citizenship").agg(F.sum("encounter_count").alias("n")), "n", 5)
    return filters.members(m, "citizenship", best, "citizenship")


@check(
    "j11_anti_derived_set",
    "enc ship",
    f"""WITH t AS ({TOP5}), m AS ({SM}) SELECT * FROM m WHERE citizenship NOT IN (SELECT citizenship FROM t)""",
)
def j11(spark, d):
    m = landed(months(enc(spark, d), "citizenship"), "months")
    best = top_with_ties(m.groupBy("citizenship").agg(F.sum("encounter_count").alias("n")), "n", 5)
    # landed, or the planner would push the join below the sums
    return filters.outsiders(landed(months(ship(spark, d), "citizenship"), "months"), "citizenship", best, "citizenship")


@check(
    "j12_bind_columns",
    "enc ship",
    """WITH a AS (SELECT date AS d1, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM enc)),
       b AS (SELECT date AS d2, row_number() OVER (ORDER BY date DESC) AS pos FROM (SELECT DISTINCT date FROM ship))
       SELECT pos, d1, d2 FROM a FULL JOIN b USING (pos)""",
)
def j12(spark, d):
    a = ordinal(enc(spark, d).select(F.col("date").alias("d1")).distinct(), [F.col("d1")], F.year("d1"), "pos")
    b = ordinal(ship(spark, d).select(F.col("date").alias("d2")).distinct(), [F.desc("d2")], -F.year("d2"), "pos")
    return joins.bind_columns(a, b, "pos")


@check(
    "j13_region_roll_up",
    "enc country",
    """SELECT e.date, coalesce(c.region, 'OTHER') AS region, CAST(sum(encounter_count) AS BIGINT) AS encounter_count
       FROM enc e LEFT JOIN (SELECT * FROM country WHERE region <> 'ASIA') c ON c.iso_code = e.citizenship GROUP BY 1, 2""",
)
def j13(spark, d):
    dim = country(spark, d).filter(F.col("region") != "ASIA").withColumnRenamed("iso_code", "citizenship")
    return joins.roll_up(enc(spark, d), dim, "citizenship", "region", ["date"], "encounter_count", rest="OTHER")


@check(
    "j14_event_markers",
    "enc",
    f"""WITH m AS ({T}), ev(date, label) AS (VALUES (date '1996-03-01', 'order ends'), (date '2000-01-01', 'agreement'), (date '2010-01-01', 'later'))
        SELECT m.date, m.encounter_count, ev.label FROM m JOIN ev USING (date)""",
)
def j14(spark, d):
    rows = [("1996-03-01", "order ends"), ("2000-01-01", "agreement"), ("2010-01-01", "later")]
    events = inline_table(spark, rows, "date string, label string").withColumn("date", F.col("date").cast("date"))
    return joins.mark_events(months(enc(spark, d)), events)


# set operations and splices


@check(
    "t1_union_by_name",
    "enc ship",
    """SELECT date, citizenship, component, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM enc GROUP BY 1, 2, 3
       UNION ALL SELECT date, citizenship, NULL, CAST(sum(encounter_count) AS BIGINT) FROM ship GROUP BY 1, 2""",
)
def t1(spark, d):
    return reshape.stack(months(enc(spark, d), "citizenship", "component"), months(ship(spark, d), "citizenship"))


@check(
    "t2_splice_before",
    "enc ship",
    f"""WITH n AS (SELECT * FROM ({M}) WHERE year(date) >= 1998), o AS ({SM})
        SELECT * FROM o WHERE date < (SELECT min(date) FROM n) UNION ALL SELECT * FROM n""",
)
def t2(spark, d):
    new = months(enc(spark, d).filter(F.year("date") >= 1998), "citizenship")
    return splice.splice_before(months(ship(spark, d), "citizenship"), new)


@check(
    "t3_splice_after",
    "enc ship",
    f"""WITH h AS (SELECT date, CAST(sum(encounter_count) AS BIGINT) AS encounter_count FROM ship WHERE year(date) < 1998 GROUP BY 1)
        SELECT * FROM h UNION ALL SELECT * FROM ({T}) WHERE date > (SELECT max(date) FROM h)""",
)
def t3(spark, d):
    history = months(ship(spark, d).filter(F.year("date") < 1998))
    return splice.splice_after(history, enc(spark, d), "encounter_count")


@check(
    "t4_splice_at",
    "enc ship",
    """SELECT CAST(fiscal_year AS INTEGER) AS fiscal_year, CAST(sum(n) AS BIGINT) AS n FROM (
         SELECT CAST(year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, encounter_count AS n
         FROM ship WHERE year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END < 1999
         UNION ALL SELECT year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END, encounter_count
         FROM enc WHERE year(date) + CASE WHEN month(date) > 9 THEN 1 ELSE 0 END >= 1999) GROUP BY 1""",
)
def t4(spark, d):
    def yearly(df):
        return df.groupBy(fiscal_year("date").alias("fiscal_year")).agg(F.sum("encounter_count").alias("n"))

    fy = F.col("fiscal_year")
    return splice.splice_at(yearly(ship(spark, d)), yearly(enc(spark, d)), fy < 1999, fy >= 1999)


@check(
    "t5_stack_tagged",
    "enc ship",
    f"""SELECT 'mex' AS location, * FROM ({SM}) UNION ALL SELECT 'swb', * FROM ({M})""",
)
def t5(spark, d):
    frames = {"mex": months(ship(spark, d), "citizenship"), "swb": months(enc(spark, d), "citizenship")}
    return reshape.stack_tagged(frames, "location")


@check(
    "t6_set_difference",
    "flow",
    """SELECT coo_iso, coa_iso FROM flow EXCEPT SELECT coo_iso, coa_iso FROM flow WHERE oip > 250""",
)
def t6(spark, d):
    f = flow(spark, d)
    return splice.without(
        f.select("coo_iso", "coa_iso"), f.filter("oip > 250").select("coo_iso", "coa_iso")
    )


