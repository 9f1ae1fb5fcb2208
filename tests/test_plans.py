"""Report plans: hand-made cases, invariants and brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.plans import cube, displacement, flows, groups, models, pathways, ranking, series
from waymark.sources.delimited import inline_table


@pytest.fixture(scope="module")
def facts(spark):
    """Three years of months; label L0 holds about 40 % of all rows; L6 stops early; some counts are null."""
    random.seed(7)
    cells = []
    for i in range(4000):
        label = "L0" if random.random() < 0.4 else f"L{random.randint(1, 6)}"
        y, m = random.randint(2021, 2023), random.randint(1, 12)
        if label == "L6" and y == 2023:
            continue
        cells.append((f"{y}-{m:02d}-01", label, random.choice("AB"), random.choice(["S", "F"]), None if i % 97 == 0 else random.randint(0, 50)))
    rows = spark.createDataFrame(cells, "date string, citizenship string, component string, demographic string, encounter_count int")
    return rows.withColumns({"date": F.col("date").cast("date"), "encounter_count": F.col("encounter_count").cast("bigint")})


def test_ranking_total_is_sum_of_all(facts):
    got = ranking.ranking_table(facts, current=2023, newer="2023-12-01", older="2023-11-01", top=100).collect()
    total = [r for r in got if r.citizenship == "Total"][0]
    parts = [r for r in got if r.citizenship != "Total"]
    assert total.encounter == sum(r.encounter for r in parts)
    assert got[0].citizenship == "Total"
    assert total.spark == [sum(x) for x in zip(*[_aligned(r, parts, facts) for r in parts])]


def _aligned(row, parts, facts):
    months = sorted(r.date for r in facts.select("date").distinct().collect())
    own = facts.filter(F.col("citizenship") == row.citizenship).groupBy("date").agg(F.sum("encounter_count").alias("v"))
    have = {r.date: r.v or 0 for r in own.collect()}
    return [have.get(m, 0) for m in months]


def test_ranking_on_cube_equals_ranking_on_facts(facts, rows):
    args = {"current": 2023, "newer": "2023-12-01", "older": "2023-11-01", "top": 3, "basis": "fiscal"}
    a = ranking.ranking_table(facts, **args).drop("spark")
    b = ranking.ranking_table(cube.month_cube(facts), **args).drop("spark")
    assert rows(a) == rows(b)


def test_ranking_drops_countries_without_both_months(facts):
    args = {"current": 2023, "newer": "2023-12-01", "older": "2023-11-01", "top": 100}
    names = {r.citizenship for r in ranking.ranking_table(facts, require_both=True, **args).collect()}
    assert "L6" not in names and "L0" in names
    assert "L6" in {r.citizenship for r in ranking.ranking_table(facts, **args).collect()}


def test_collapse_keeps_total(facts):
    whole = facts.agg(F.sum("encounter_count")).first()[0]
    got = groups.collapse_small(facts, "citizenship", "encounter_count", 0.11)
    assert got.agg(F.sum("encounter_count")).first()[0] == whole
    assert "Other" in {r.citizenship for r in got.collect()}
    area = groups.share_area(got, "citizenship", "encounter_count", groups.SUBREGIONS).collect()
    assert round(sum(r.share for r in area), 6) == 100 and round(max(r.cumulative_share for r in area), 6) == 100


def test_group_shares_sum_to_one(facts):
    wide = series.component_share(facts, {"G": ["L0", "L1"]}, "A").join(
        series.component_share(facts, {"G": ["L0", "L1"]}, "B"), "date"
    )
    assert wide.count() == 36
    sums = [r[1] + r[3] for r in wide.collect()]
    assert all(abs(s - 1) < 1e-9 for s in sums)


def test_header_indicators_take_components_in_name_order(spark):
    df = inline_table(spark, [("2024-02-01", "A", 10), ("2024-02-01", "B", 15), ("2024-01-01", "C", 1)], "date date, component string, encounter_count bigint")
    got = series.header_indicators(df, "2024-02-01", [1, 2]).filter("indicator = 'component'").orderBy("period").collect()
    assert [(r.period, r.pct) for r in got] == [("A", None), ("B", 0.5)]


def test_relative_displacement_equals_loop(spark):
    random.seed(3)
    cells = [(y, f"C{i}", h, random.randint(1, 99)) for y in range(2010, 2024) for i in range(4) for h in ("US", "X", "Y")]
    df = inline_table(spark, cells, "year int, coo_iso string, coa_iso string, fdp bigint")
    for inclusive in (True, False):
        got = displacement.relative_displacement(df, [2013, 2018, 2021], 2023, "fdp", "US", inclusive=inclusive)
        for r in got.collect():
            span = [c for c in cells if c[0] >= r.base_year + (0 if inclusive else 1) and c[0] <= 2023]
            us, rest = sum(c[3] for c in span if c[2] == "US"), sum(c[3] for c in span if c[2] != "US")
            assert (r.host_total, r.rest_total) == (us, rest)
            assert abs(r.relative - rest / us) < 1e-12 and abs(r.host_share - us / (us + rest)) < 1e-12


def test_measures_treat_missing_as_zero(spark):
    df = inline_table(spark, [(None, 5, 1)], "refugees int, asylum_seekers int, oip int")
    assert displacement.with_measures(df, {"dp": "dp"}).first().dp == 6


def test_edges_balance(spark):
    df = inline_table(spark, [("a", "x", "p", 5), ("a", "y", "p", 7), ("b", "x", "q", 2), ("b", "x", "q", 1)], "s1 string, s2 string, s3 string, v bigint")
    edges = flows.edge_table(df, ["s1", "s2", "s3"], "v")
    sums = edges.groupBy("stage", "connector").agg(F.sum("v").alias("v")).collect()
    assert {r.v for r in sums} == {15} and len(sums) == 4
    assert {r.node: r.node_total for r in edges.collect()} == {"a": 0, "b": 0, "x": 8, "y": 7, "p": 12, "q": 3}


def test_staged_split_keeps_total(spark):
    df = inline_table(spark, [("H1", 100), ("H2", 50), ("Z", 30), ("Y", 20)], "coa_iso string, dp bigint")
    regular = inline_table(spark, [("H1", 60), ("OTHER", 5)], "host string, regular bigint")
    got = flows.staged_split(df, ["H1", "H2"], regular, "dp")
    assert {r.t for r in got.groupBy("stage").agg(F.sum("dp").alias("t")).collect()} == {200}
    cells = {(r.stage, r.node_from, r.node_to, r.kind): r.dp for r in got.collect()}
    assert cells[1, "LAC", "H1", "regular"] == 60 and cells[1, "LAC", "H1", "irregular"] == 40
    assert cells[2, "H1", "transparent", "regular"] == 60 and cells[2, "OTHER", "H2", "irregular"] == 50


def test_centroid_of_square_and_triangle(spark):
    cells = [("sq", 1, 0.0, 0.0), ("sq", 2, 4.0, 0.0), ("sq", 3, 4.0, 2.0), ("sq", 4, 0.0, 2.0), ("tr", 1, 0.0, 0.0), ("tr", 2, 3.0, 0.0), ("tr", 3, 0.0, 3.0)]
    df = inline_table(spark, cells, "k string, pos int, x double, y double")
    got = {r.k: (round(r.x, 9), round(r.y, 9)) for r in flows.centroids(df, "k").collect()}
    assert got == {"sq": (2, 1), "tr": (1, 1)}


def test_centroid_of_large_whole_coordinates(spark):
    # sums of third powers leave the range of a long, and of the digits of a double
    big, far = 4_000_000_000, 10**12
    cells = [("sq", 1, 0, 0), ("sq", 2, big, 0), ("sq", 3, big, big), ("sq", 4, 0, big)]
    cells += [("tr", 1, far, far), ("tr", 2, far + 3, far), ("tr", 3, far, far + 3), ("no", 1, big, 0), ("no", 2, big, big)]
    df = inline_table(spark, cells, "k string, pos int, x bigint, y bigint")
    found = flows.centroids(df, "k")
    assert found.schema["x"].dataType.typeName() == "double"
    got = {r.k: (r.x, r.y) for r in found.collect()}
    assert got.pop("no") == (None, None)
    assert {k: [round(v, 3) for v in c] for k, c in got.items()} == {"sq": [big / 2] * 2, "tr": [far + 1] * 2}
    small = df.filter("k = 'sq'").select("k", "pos", (F.col("x") / 40_000).cast("int").alias("x"), (F.col("y") / 40_000).cast("int").alias("y"))
    assert [(round(r.x, 6), round(r.y, 6)) for r in flows.centroids(small, "k").collect()] == [(50_000, 50_000)]


def test_growth_with_own_base_year(spark):
    df = inline_table(spark, [("H2A", 2016, 100), ("H2A", 2023, 200), ("R", 2017, 50), ("R", 2023, 100), ("Z", 2023, 4)], "cat string, fiscal_year int, value bigint")
    got = {r.cat: r for r in pathways.growth_table(df, "cat", 2016, 2023, {"R": 2017}).collect()}
    assert abs(got["H2A"].cagr - (2 ** (1 / 7) - 1)) < 1e-12 and abs(got["R"].cagr - (2 ** (1 / 6) - 1)) < 1e-12
    assert got["Z"].pct_change is None and got["Z"].first_value is None


def _spline(x, y, at):
    """Brute force: one dense system for all cubic pieces."""
    k = len(y) - 1
    a, b = [], []
    for i in range(k):
        h = x[i + 1] - x[i]
        for t, value in ((0.0, y[i]), (h, y[i + 1])):
            row = np.zeros(4 * k)
            row[4 * i : 4 * i + 4] = [1, t, t**2, t**3]
            a.append(row)
            b.append(value)
    for i in range(k - 1):
        h = x[i + 1] - x[i]
        for left, right in (([0, 1, 2 * h, 3 * h * h], [0, 1, 0, 0]), ([0, 0, 2, 6 * h], [0, 0, 2, 0])):
            row = np.zeros(4 * k)
            row[4 * i : 4 * i + 4] = left
            row[4 * i + 4 : 4 * i + 8] = [-v for v in right]
            a.append(row)
            b.append(0)
    for i, cell in ((0, [0, 0, 2, 0]), (k - 1, [0, 0, 2, 6 * (x[k] - x[k - 1])])):
        row = np.zeros(4 * k)
        row[4 * i : 4 * i + 4] = cell
        a.append(row)
        b.append(0)
    c = np.linalg.solve(np.array(a), np.array(b))
    out = []
    for v in at:
        i = min(int(np.searchsorted(x, v, side="right")) - 1, k - 1)
        t = v - x[i]
        out.append(c[4 * i : 4 * i + 4] @ [1, t, t**2, t**3])
    return np.array(out)


def test_monthly_curve_against_brute_force_with_gaps_and_long_keys(spark):
    years, y = [2000, 2001, 2002, 2005, 2009, 2010], [3.0, 8.0, 1.0, 4.0, 4.5, 9.0]
    cells = [(7, t, v) for t, v in zip(years, y)] + [(8, 2000, 1.0)] + [(9, t, float(t)) for t in (2000, 2001, 2005)]
    df = inline_table(spark, cells, "k bigint, year int, rate double")
    rows = models.yearly_to_monthly(df, "k", "year", "rate").orderBy("k", "date").collect()
    curve = [r.rate for r in rows if r.k == 7]
    assert np.allclose(curve, _spline(np.array(years, float), y, 2000 + np.arange(len(curve)) / 12))
    assert [r.rate for r in rows if r.k == 8] == [1.0]
    line = [r for r in rows if r.k == 9]  # a straight line stays one across the gap
    assert np.allclose([r.rate for r in line], [r.date.year + (r.date.month - 1) / 12 for r in line])


def test_yearly_to_monthly_hits_every_january_of_even_steps(spark):
    cells = [(k, 2000 + i, float(v)) for k in "ab" for i, v in enumerate([5, 9, 2, 7])]
    df = inline_table(spark, cells, "k string, year int, rate double")
    got = models.yearly_to_monthly(df, "k", "year", "rate").filter("k = 'a'").orderBy("date").collect()
    assert len(got) == 37 and [round(got[i].rate, 9) for i in (0, 12, 24, 36)] == [5, 9, 2, 7]


def test_spline_regression_against_numpy(spark):
    random.seed(1)
    days = [dt.date(2000 + i // 12, i % 12 + 1, 1) for i in range(60)]
    value = {d: 100 + 30 * np.sin(i / 9) + random.random() for i, d in enumerate(days)}
    df = inline_table(spark, [("s", str(d), float(v)) for d, v in value.items()], "k string, date date, v double")
    got = {r.date: r.predicted for r in models.spline_regression(df, "k", "v").collect()}
    t = np.array([(d - dt.date(1970, 1, 1)).days for d in days], dtype=float)
    knots = np.quantile(t, np.linspace(0, 1, 6))

    def d(k):
        cube_of = lambda c: np.maximum(t - c, 0) ** 3
        return (cube_of(knots[k]) - cube_of(knots[-1])) / (knots[-1] - knots[k])

    basis = np.column_stack([np.ones_like(t), t, *[d(k) - d(4) for k in range(4)]])
    basis = basis / np.abs(basis).max(axis=0)
    fit = basis @ np.linalg.lstsq(basis, np.array([value[x] for x in days]), rcond=None)[0]
    assert np.allclose([got[x] for x in days], fit, atol=1e-5)


def test_short_series_are_not_lost(spark):
    cells = [("long", f"2000-{m:02d}-01", float(m)) for m in range(1, 13)]
    cells += [("four", f"2001-{m:02d}-01", float(m * m)) for m in range(1, 5)] + [("one", "2001-05-01", 7.0)]
    df = inline_table(spark, cells, "k string, date date, v double")
    got = models.spline_regression(df, "k", "v").collect()
    assert len(got) == len(cells)
    assert all(abs(r.predicted - r.v) < (0.1 if r.k == "long" else 1e-6) for r in got)


def test_unlisted_demographics_count(spark):
    cells = [("2001-01-01", "A", d, n) for d, n in (("X", 10), ("Y", 3), ("Z", 100))] + [("2001-02-01", "A", "X", 5)]
    df = inline_table(spark, cells, "date date, citizenship string, demographic string, encounter_count bigint")
    got = series.demographic_series(df, ["A"], {"X": "Ex", "W": "Double"}, ["Ex", "Double"]).collect()
    cell = {(r.date.month, r.label): (r.encounter_count, r.summig, r.label_ord) for r in got}
    assert cell[(1, "Z")] == (100, 113, 3) and cell[(1, "Double")] == (0, 113, 2) and cell[(2, "Y")] == (0, 5, 3)


def test_top_other_series_reads_the_facts_once(spark):
    cells = [(f"2000-{m:02d}-01", f"C{c}", c * m) for m in range(1, 5) for c in range(1, 6)]
    df = inline_table(spark, cells, "date date, citizenship string, encounter_count bigint")
    out = series.top_other_series(df, ["C5"], 2)
    assert {r.citizenship for r in out.collect()} == {"C4", "C3"}
    assert "LocalTableScan" not in out._jdf.queryExecution().executedPlan().toString()  # only the landed months


def test_month_cube_refresh_touches_only_changed_months(spark, facts, rows, tmp_path):
    path = str(tmp_path / "c")

    def files():
        return {f.parent.name: {x.name for x in f.parent.glob("*.parquet")} for f in tmp_path.glob("c/cube/*/*.parquet")}

    undated = facts.limit(3).withColumn("date", F.lit(None).cast("date"))
    whole = facts.unionByName(undated)
    assert len(cube.refresh_month_cube(whole, path)) == 37
    assert rows(cube.read_refreshed_cube(spark, path)) == rows(cube.month_cube(whole).select(*cube.read_refreshed_cube(spark, path).columns))
    before = files()
    assert cube.refresh_month_cube(whole.repartition(3), path) == [] and files() == before
    # one month restated, one gone, a row twice in a third; earlier months are not looked at
    month = F.date_format("date", "yyyy-MM")
    new = whole.filter(F.coalesce(month != "2023-04", F.lit(True)))
    new = new.withColumn("encounter_count", F.when(month.isin("2023-02", "2021-05"), F.col("encounter_count") + 1).otherwise(F.col("encounter_count")))
    new = new.unionByName(new.filter(month == "2023-06").limit(1))
    assert cube.refresh_month_cube(new, path, since=dt.date(2022, 1, 15)) == ["2023-02", "2023-06", "2023-04"]
    after = files()
    changed = {m for m in before.keys() | after.keys() if before.get(m) != after.get(m)}
    assert changed == {"cube_month=2023-02", "cube_month=2023-04", "cube_month=2023-06"}
    assert cube.refresh_month_cube(new, path) == ["2021-05"]
    assert rows(cube.read_refreshed_cube(spark, path)) == rows(cube.month_cube(new).select(*cube.read_refreshed_cube(spark, path).columns))
    assert cube.refresh_month_cube(new.filter("date is not null"), path) == [None]
    assert cube.read_refreshed_cube(spark, path, dt.date(2023, 1, 1)).agg(F.min("date")).first()[0] == dt.date(2023, 1, 1)
