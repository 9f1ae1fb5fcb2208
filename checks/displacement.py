"""Displacement measures, host comparisons, flow edges and flow lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import HOST, check, country, enc, flow, internal, r6, rounded, ship
from waymark.operators.filters import across_borders, members
from waymark.plans import displacement as dp
from waymark.plans import flows
from waymark.sources.delimited import inline_table

REGION = "AMERICA"

# internal displacement as a stock, and a camp register, on the same keys as the population table
SOURCES = """idmc AS (SELECT year, iso3 AS coo_iso, iso3 AS coa_iso, conflict_internal_displacements AS idmc FROM internal),
camps AS (SELECT CAST(year(date) AS INTEGER) AS year, citizenship AS coo_iso, 'NATION_1' AS coa_iso, CAST(sum(encounter_count) AS BIGINT) AS unrwa
          FROM ship WHERE citizenship IN ('NATION_6', 'NATION_7') GROUP BY 1, 2),
stock AS (SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) AS refugees, coalesce(asylum_seekers, 0) AS asylum_seekers, coalesce(oip, 0) AS oip,
             CASE WHEN coo_iso = 'NATION_1' AND coa_iso = 'NATION_1' THEN coalesce(idmc, 0) * 0.3::DOUBLE ELSE CAST(coalesce(idmc, 0) AS DOUBLE) END AS idmc,
             coalesce(unrwa, 0) AS unrwa
          FROM flow FULL JOIN idmc USING (year, coo_iso, coa_iso) FULL JOIN camps USING (year, coo_iso, coa_iso)),
fd AS (SELECT *, idmc + oip + refugees + unrwa + asylum_seekers AS fdp, oip + refugees + unrwa + asylum_seekers AS fdps,
          oip + refugees + unrwa + asylum_seekers AS fdpa FROM stock)"""

FLOWS = """fl AS (SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) AS refugees, coalesce(asylum_seekers, 0) AS asylum_seekers, coalesce(oip, 0) AS oip,
         coalesce(refugee_like, 0) AS refugee_like, coalesce(conflict_internal_displacements, 0) AS conflict_internal_displacements
       FROM (SELECT *, refugees // 10 AS refugee_like FROM flow)
       FULL JOIN (SELECT year, iso3 AS coo_iso, iso3 AS coa_iso, conflict_internal_displacements FROM internal) USING (year, coo_iso, coa_iso)),
ff AS (SELECT year, coo_iso, coa_iso, CAST(oip + refugees + asylum_seekers + refugee_like + conflict_internal_displacements AS BIGINT) AS fdp,
          CAST(oip + refugees + asylum_seekers + refugee_like AS BIGINT) AS fdpa, conflict_internal_displacements FROM fl)"""

IN_SCOPE = """coo_iso IN (SELECT iso_code FROM country WHERE region = 'AMERICA')
  AND (coa_iso IN (SELECT iso_code FROM country WHERE region = 'AMERICA') OR coa_iso = 'NATION_1')"""


def region(spark, d):
    return country(spark, d).filter(F.col("region") == REGION)


def stock(spark, d):
    idmc = internal(spark, d).select(
        "year", F.col("iso3").alias("coo_iso"), F.col("iso3").alias("coa_iso"),
        F.col("conflict_internal_displacements").alias("idmc"),
    )
    s = ship(spark, d).filter(F.col("citizenship").isin("NATION_6", "NATION_7"))
    camps = s.groupBy(F.year("date").alias("year"), F.col("citizenship").alias("coo_iso"), F.lit(HOST).alias("coa_iso"))
    return dp.stock(flow(spark, d), idmc, camps.agg(F.sum("encounter_count").alias("unrwa")), doubled=HOST)


def yearly_flows(spark, d):
    cross = flow(spark, d).withColumn("refugee_like", F.floor(F.col("refugees") / 10))
    own = internal(spark, d).select("year", "iso3", "conflict_internal_displacements")
    return dp.flows(cross, own)


def scoped_flows(spark, d):
    return dp.scope(yearly_flows(spark, d), region(spark, d), HOST)


@check(
    "d21_displacement_measures",
    "flow",
    """WITH f AS (SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) AS r, coalesce(asylum_seekers, 0) AS a, coalesce(oip, 0) AS o,
                         coalesce(refugees, 0) // 2 AS i, coalesce(oip, 0) // 3 AS p, coalesce(oip, 0) // 4 AS c FROM flow)
       SELECT year, coo_iso, coa_iso, r + a + o AS dp, r + a + o + p AS dp_pal, r + a + o + i + p AS fdp, r + a + o + p AS fidp,
              2 * i + o + r + 3 * p + a AS fdp_idmc, i + o + r + 3 * p + a + c + c AS fdps, o + r + 3 * p + a AS fdpa FROM f""",
)
def d21(spark, d):
    def part(column, by):
        return F.floor(F.coalesce(F.col(column), F.lit(0)) / by)

    f = flow(spark, d)
    f = f.withColumns({"idps": part("refugees", 2), "pal_ref": part("oip", 3), "ooc": part("oip", 4)})
    f = f.withColumns({"stateless": F.col("ooc"), "idmc": F.col("idps") * 2, "unrwa": F.col("pal_ref") * 3})
    names = ["dp", "dp_pal", "fdp", "fidp", "fdp_idmc", "fdps", "fdpa"]
    return dp.with_measures(f, {n: n for n in names}).select("year", "coo_iso", "coa_iso", *names)


@check(
    "d22_scale_pair",
    "flow internal ship",
    f"WITH {SOURCES} SELECT year, coo_iso, coa_iso, round(idmc, 6) AS idmc, round(fdp, 6) AS fdp, fdps, fdpa FROM fd",
)
def d22(spark, d):
    return rounded(stock(spark, d).select("year", "coo_iso", "coa_iso", "idmc", "fdp", "fdps", "fdpa"), "idmc", "fdp")


@check(
    "d23_stock_difference",
    "flow internal ship country",
    f"""WITH {SOURCES}, g AS (SELECT year, CASE WHEN coa_iso = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END AS coa_g, CAST(sum(fdpa) AS BIGINT) AS n
         FROM fd WHERE {IN_SCOPE} GROUP BY 1, 2)
       SELECT coa_g, max(n) FILTER (year = 1996) AS y1, max(n) FILTER (year = 2000) AS y2,
              max(n) FILTER (year = 2000) - max(n) FILTER (year = 1996) AS diff FROM g GROUP BY 1""",
)
def d23(spark, d):
    return dp.stock_difference(dp.scope(stock(spark, d), region(spark, d), HOST), 1996, 2000, "fdpa", HOST)


@check(
    "d24_flow_difference",
    "flow internal country",
    f"""WITH {FLOWS} SELECT CASE WHEN coa_iso = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END AS coa_g, CAST(sum(fdp) AS BIGINT) AS fdp
       FROM ff WHERE {IN_SCOPE} AND year BETWEEN 1996 AND 2000 GROUP BY 1""",
)
def d24(spark, d):
    return dp.flow_difference(scoped_flows(spark, d), 1996, 2000, "fdp", HOST)


def _relative(test):
    return f"""WITH {FLOWS}, b(base_year) AS (VALUES (1996), (1998), (2000)),
       g AS (SELECT base_year, CAST(sum(fdpa) FILTER (coa_iso = 'NATION_1') AS BIGINT) AS host_total, CAST(sum(fdpa) FILTER (coa_iso <> 'NATION_1') AS BIGINT) AS rest_total
             FROM ff JOIN b ON {test} WHERE {IN_SCOPE} AND year <= 2001 GROUP BY 1)
       SELECT base_year, host_total, rest_total, round(CAST(rest_total AS DOUBLE) / nullif(host_total, 0), 6) AS relative,
              round(CAST(host_total AS DOUBLE) / nullif(host_total + rest_total, 0), 6) AS host_share FROM g"""


@check("d25_relative_displacement", "flow internal country", _relative("year >= base_year"))
def d25(spark, d):
    rows = dp.relative_displacement(scoped_flows(spark, d), [1996, 1998, 2000], 2001, "fdpa", HOST)
    return rounded(rows, "relative", "host_share")


@check("d25_relative_displacement_after", "flow internal country", _relative("year > base_year"))
def d25_after(spark, d):
    rows = dp.relative_displacement(scoped_flows(spark, d), [1996, 1998, 2000], 2001, "fdpa", HOST, inclusive=False)
    return rounded(rows, "relative", "host_share")


@check(
    "d26_internal_with_flow",
    "flow internal country",
    f"""WITH {FLOWS}, i AS (SELECT year, CASE WHEN iso3 = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END AS coa_g, sum(conflict_internal_displacements) AS c
         FROM internal WHERE iso3 IN (SELECT iso_code FROM country WHERE region = 'AMERICA') GROUP BY 1, 2),
       g AS (SELECT year, CASE WHEN coa_iso = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END AS coa_g, sum(fdpa) AS fdp FROM ff WHERE {IN_SCOPE} AND year > 1996 GROUP BY 1, 2)
       SELECT coa_g, CAST(sum(fdp) AS BIGINT) AS fdp, CAST(sum(fdp + c) AS BIGINT) AS fdp2, CAST(sum(c) AS BIGINT) AS conflict_internal_displacements
       FROM g LEFT JOIN i USING (year, coa_g) GROUP BY 1""",
)
def d26(spark, d):
    cross = scoped_flows(spark, d).drop("fdp").withColumnRenamed("fdpa", "fdp")
    own = members(internal(spark, d), "iso3", region(spark, d), "iso_code")
    return dp.internal_with_flow(cross, own, 1996, HOST)


@check(
    "d27_series_by_class",
    "flow",
    """WITH f AS (SELECT year, coo_iso, coa_iso, coalesce(refugees, 0) + coalesce(asylum_seekers, 0) + coalesce(oip, 0) AS dp FROM flow WHERE coo_iso <> coa_iso)
       SELECT year, 'class' AS kind, CASE WHEN coo_iso = 'NATION_2' THEN 'One' WHEN coo_iso IN ('NATION_3', 'NATION_4') THEN 'Near' ELSE 'Extraregional' END AS origin_class,
              CASE WHEN coa_iso = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END AS host_class, CAST(sum(dp) AS BIGINT) AS dp FROM f GROUP BY 1, 3, 4
       UNION ALL SELECT year, 'dual', 'all_origins', CASE WHEN coa_iso = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END, CAST(sum(dp) AS BIGINT) FROM f GROUP BY 1, 4
       UNION ALL SELECT year, 'dual', 'one_origin', CASE WHEN coa_iso = 'NATION_1' THEN 'NATION_1' ELSE 'LAC' END,
              CAST(sum(CASE WHEN coo_iso = 'NATION_2' THEN dp ELSE 0 END) AS BIGINT) FROM f GROUP BY 1, 4""",
)
def d27(spark, d):
    f = dp.with_measures(across_borders(flow(spark, d)), {"dp": "dp"})
    by_class = dp.series_by_class(f, "dp", {"One": ["NATION_2"], "Near": ["NATION_3", "NATION_4"]}, HOST, "LAC")
    dual = dp.dual_series(f, "dp", "NATION_2", HOST, "LAC").withColumnRenamed("measure", "origin_class")
    return by_class.withColumn("kind", F.lit("class")).unionByName(dual.withColumn("kind", F.lit("dual")))


EDGE_BASE = """p AS (SELECT CASE WHEN coo_iso IN ('NATION_2', 'NATION_3') THEN coo_iso ELSE 'OTHER' END AS coo, CASE WHEN coa_iso IN ('NATION_1', 'NATION_4') THEN coa_iso ELSE 'REST' END AS coa,
   CAST(sum(coalesce(refugees, 0) + coalesce(asylum_seekers, 0) + coalesce(oip, 0)) AS BIGINT) AS dp, year FROM flow GROUP BY 1, 2, year)"""


@check(
    "d28_edge_table",
    "flow",
    f"""WITH {EDGE_BASE}, e AS (SELECT coo || '>' || coa || '#1' AS edge_id, 'from' AS connector, 'coo' AS stage, coo AS node, coo AS by_coo, dp, year FROM p
         UNION ALL SELECT coo || '>' || coa || '#1', 'to', 'coa', coa, coo, dp, year FROM p),
       n AS (SELECT node, coalesce(sum(dp) FILTER (connector = 'to'), 0) AS node_total FROM e GROUP BY 1)
       SELECT e.*, CAST(node_total AS BIGINT) AS node_total FROM e JOIN n USING (node) WHERE dp >= 1000""",
)
def d28(spark, d):
    f = dp.with_measures(flow(spark, d), {"dp": "dp"})
    coo = F.when(F.col("coo_iso").isin("NATION_2", "NATION_3"), F.col("coo_iso")).otherwise("OTHER")
    coa = F.when(F.col("coa_iso").isin(HOST, "NATION_4"), F.col("coa_iso")).otherwise("REST")
    rows = f.select(coo.alias("coo"), coa.alias("coa"), "year", "dp")
    return flows.edge_table(rows, ["coo", "coa"], "dp", extra=["coo", "year"], least=1000)


@check(
    "d29_staged_split",
    "flow",
    """WITH t AS (SELECT CASE WHEN coa_iso IN ('NATION_1', 'NATION_4', 'NATION_7') THEN coa_iso ELSE 'OTHER' END AS host,
              sum(coalesce(refugees, 0) + coalesce(asylum_seekers, 0) + coalesce(oip, 0)) AS dp FROM flow GROUP BY 1),
       k(host, turn, regular) AS (VALUES ('NATION_1', 1, 500), ('NATION_4', 2, 300), ('NATION_7', 3, 0), ('OTHER', 4, 50)),
       p AS (SELECT host, turn, 'regular' AS kind, regular AS amount FROM t JOIN k USING (host) UNION ALL SELECT host, turn, 'irregular', dp - regular FROM t JOIN k USING (host)),
       s AS (SELECT unnest([1, 2, 3]) AS stage),
       n AS (SELECT stage, kind, amount,
          CASE WHEN stage = 1 THEN 'LAC' WHEN host = 'OTHER' THEN 'OTHER' WHEN stage <= turn THEN 'OTHER' WHEN stage = turn + 1 THEN host ELSE 'transparent' END AS node_from,
          CASE WHEN host = 'OTHER' THEN 'OTHER' WHEN stage + 1 <= turn THEN 'OTHER' WHEN stage = turn THEN host ELSE 'transparent' END AS node_to
          FROM p CROSS JOIN s WHERE amount > 0)
       SELECT CAST(stage AS INTEGER) AS stage, node_from, node_to, kind, CAST(sum(amount) AS BIGINT) AS dp FROM n GROUP BY 1, 2, 3, 4""",
)
def d29(spark, d):
    f = dp.with_measures(flow(spark, d), {"dp": "dp"})
    regular = inline_table(
        spark,
        [(HOST, 500), ("NATION_4", 300), ("NATION_7", 0), ("OTHER", 50)], "host string, regular bigint"
    )
    return flows.staged_split(f, [HOST, "NATION_4", "NATION_7"], regular, "dp")


@check(
    "d30_flow_lines",
    "enc ship",
    """WITH r AS (SELECT citizenship, month(date) AS pos, sum(encounter_count) AS n FROM enc GROUP BY 1, 2),
       v AS (SELECT citizenship, pos, n * c.cx AS x, n * c.cy AS y FROM r JOIN (VALUES (1, 2, 0), (2, 2, 1), (3, 1, 2), (4, 0, 2), (5, -1, 2), (6, -2, 1), (7, -2, 0), (8, -2, -1), (9, -1, -2), (10, 0, -2), (11, 1, -2), (12, 2, -1)) c(pos, cx, cy) USING (pos)),
       e AS (SELECT a.citizenship, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON a.citizenship = b.citizenship AND b.pos = a.pos % 12 + 1),
       c AS (SELECT citizenship, CAST(sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS DOUBLE) / CAST(3 * sum(x1 * y2 - x2 * y1) AS DOUBLE) AS x,
                    CAST(sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS DOUBLE) / CAST(3 * sum(x1 * y2 - x2 * y1) AS DOUBLE) AS y FROM e GROUP BY 1),
       k AS (SELECT citizenship, 'southwest' AS code, CAST(sum(encounter_count) AS BIGINT) AS ac FROM enc GROUP BY 1
             UNION ALL SELECT citizenship, 'darien', CAST(sum(encounter_count) AS BIGINT) FROM ship GROUP BY 1),
       l(code, xend, yend, location) AS (VALUES ('darien', -77.0::DOUBLE, 7.0::DOUBLE, 'Darien Gap'), ('southwest', -98.0, 39.0, 'US Southwest Border'), ('mexico', -102.5, 23.5, 'Mexico Border'))
       SELECT c.citizenship, round(c.x, 6) AS x, round(c.y, 6) AS y, k.ac, l.xend, l.yend, l.location, CASE WHEN k.ac IS NULL THEN 0 ELSE 1 END AS alpha
       FROM c CROSS JOIN l LEFT JOIN k ON k.citizenship = c.citizenship AND k.code = l.code""",
)
def d30(spark, d):
    # outline of each country: twelve corners whose distance is the month's encounters
    e = enc(spark, d)
    radius = e.groupBy("citizenship", F.month("date").alias("pos")).agg(F.sum("encounter_count").alias("n"))
    xs, ys = [2, 2, 1, 0, -1, -2, -2, -2, -1, 0, 1, 2], [0, 1, 2, 2, 2, 1, 0, -1, -2, -2, -2, -1]

    def corner(values):
        return F.col("n") * F.get(F.array(*[F.lit(v) for v in values]), F.col("pos") - 1)

    outline = radius.select("citizenship", "pos", corner(xs).alias("x"), corner(ys).alias("y"))
    origins = flows.centroids(outline, "citizenship")
    counts = e.select("citizenship", F.lit("southwest").alias("location"), "encounter_count")
    counts = counts.unionByName(ship(spark, d).select("citizenship", F.lit("darien").alias("location"), "encounter_count"))
    lines = flows.flow_lines(origins, counts, "citizenship")
    return lines.select("citizenship", r6("x"), r6("y"), "ac", "xend", "yend", "location", "alpha")
