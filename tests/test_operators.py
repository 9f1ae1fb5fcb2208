"""Operators on small frames: ties, nulls, gaps, hot groups and repeated keys."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import aggregates as agg
from waymark.operators import cleaning, filters, joins, order, reshape, splice
from waymark.sources.delimited import inline_table


def day(y, m):
    return dt.date(y, m, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """Rows of which one key holds more than a third."""
    key = F.when(F.col("id") % 5 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 37))
    return spark.range(3000).select(key.alias("k"), ((F.col("id") * 7919) % 1009 - 300).alias("v"), F.col("id").alias("line"))


def test_top_keeps_ties(spark, rows):
    df = inline_table(spark, [("a", 9), ("b", 7), ("c", 7), ("d", 7), ("e", 1), ("f", None)], "k string, v int")
    assert rows(order.top_with_ties(df, "v", 2)) == [("a", 9, 1), ("b", 7, 2), ("c", 7, 2), ("d", 7, 2)]
    assert len(rows(order.top_with_ties(df, "v", 50))) == 5


def test_running_total_matches_plain_order(spark, hot):
    got = order.running_total(hot, "v", [F.col("line")], order.line_block("line", 100), "upto").orderBy("line").collect()
    total = 0
    for r in got:
        total += r.v
        assert r.upto == total
    assert len(got) == 3000


def test_running_total_by_magnitude_in_groups(hot):
    counts = hot.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    got = order.running_total(counts, "n", [F.col("v")], order.magnitude_block("v"), "upto", ["k"]).collect()
    for key in {r.k for r in got}:
        total = 0
        for r in sorted((r for r in got if r.k == key), key=lambda r: r.v):
            total += r.n
            assert r.upto == total


def test_magnitude_block_never_falls(spark):
    values = sorted([0.0, 1e-7, 1e-3, 0.5, 1.0, 1.5, 2.0, 99.0, 1e6, 1e12, -1e-3, -5.0, -1e9])
    df = inline_table(spark, [(v,) for v in values], "v double")
    got = [r.b for r in df.select("v", order.magnitude_block("v", 256).alias("b")).orderBy("v").collect()]
    assert got == sorted(got)


def test_fill_down_crosses_blocks_and_files(spark):
    cells = [("f1", i, "A" if i == 0 else ("B" if i == 57 else None)) for i in range(90)]
    cells += [("f2", i, "C" if i == 3 else None) for i in range(30)]
    df = inline_table(spark, cells, "f string, line bigint, v string")
    got = {(r.f, r.line): r.v for r in order.fill_down(df, ["v"], "line", ["f"], size=7).collect()}
    assert all(got["f1", i] == ("A" if i < 57 else "B") for i in range(90))
    assert all(got["f2", i] == ("C" if i >= 3 else None) for i in range(30))


@pytest.mark.parametrize("n", [1, 2, 7, 500, 501])
def test_exact_median(spark, n):
    random.seed(n)
    values = [random.choice([round(random.gauss(0, 50), 3), 4.0]) for _ in range(n)]
    df = inline_table(spark, [(v, "x") for v in values], "v double, k string")
    want = round(statistics.median(values), 9)
    assert round(order.exact_median(df, "v").first().median, 9) == want
    assert round(order.exact_median(df, "v", ["k"]).first().median, 9) == want


def test_median_of_hot_groups(hot):
    got = {r.k: r.median for r in order.exact_median(hot, "v", ["k"]).collect()}
    local = hot.toPandas().groupby("k").v.median()
    assert got == {k: float(v) for k, v in local.items()}


def test_dense_position_and_label_order(spark, rows):
    df = inline_table(spark, [("a", 3), ("b", 5), ("c", 5), ("d", -1), ("a", 1)], "k string, v int")
    got = rows(order.ranked_labels(df, "k", "v", "ord").select("k", "ord").distinct())
    assert got == [("a", 2), ("b", 1), ("c", 1), ("d", 3)]


def test_explicit_order_puts_unknown_last(spark, rows):
    df = inline_table(spark, [("x",), ("b",), ("a",), (None,)], "k string")
    assert rows(df.select("k", order.by_order("k", ["b", "a"]).alias("o"))) == [(None, 3), ("a", 2), ("b", 1), ("x", 3)]


def test_latest_per_group_takes_whole_row(spark, rows):
    df = inline_table(spark, [("a", 1, "old", 9), ("a", 2, None, 1), ("b", 1, "x", 3)], "k string, d int, s string, v int")
    assert rows(order.latest_per_group(df, ["k"], ["d"])) == [("a", 2, None, 1), ("b", 1, "x", 3)]


def test_lookup_fails_on_repeated_key(spark):
    fact = inline_table(spark, [("a", 1)], "k string, v int")
    dim = inline_table(spark, [("a", 1), ("a", 2)], "k string, w int")
    with pytest.raises(Exception, match="repeated key"):
        joins.lookup(fact, dim, ["k"]).collect()
    assert joins.lookup(fact, dim, ["k"], any_match=True).collect()[0].w == 1


def test_null_keys_meet_only_on_request(spark, rows):
    fact = inline_table(spark, [("a", 1), (None, 2)], "k string, v int")
    dim = inline_table(spark, [(None, 7), ("a", 8)], "k string, w int")
    assert rows(joins.lookup(fact, dim, ["k"])) == [(None, 2, None), ("a", 1, 8)]
    assert rows(joins.lookup(fact, dim, ["k"], null_safe=True)) == [(None, 2, 7), ("a", 1, 8)]


def test_combine_sources_fills_zero(spark, rows):
    a = inline_table(spark, [(1, "x", 5)], "y int, k string, a int")
    b = inline_table(spark, [(1, "x", 7), (2, "x", 1)], "y int, k string, b int")
    c = inline_table(spark, [(3, "z", 2)], "y int, k string, c int")
    assert rows(joins.combine_sources([a, b, c], ["y", "k"])) == [(1, "x", 5, 7, 0), (2, "x", 0, 1, 0), (3, "z", 0, 0, 2)]


def test_not_in_keeps_null(spark, rows):
    df = inline_table(spark, [("a",), ("b",), (None,)], "k string")
    assert rows(df.filter(filters.not_in("k", ["a"]))) == [(None,), ("b",)]
    gone = inline_table(spark, [("a",)], "g string")
    assert rows(filters.outsiders(df, "k", gone, "g")) == [(None,), ("b",)]


def test_group_totals_with_null_key_and_hot_group(spark, hot):
    df = hot.unionByName(inline_table(spark, [(None, 4, -1), (None, 6, -2)], "k string, v bigint, line bigint"))
    got = agg.attach_group(df, ["k"], t=F.sum("v"))
    assert got.count() == 3002
    assert {r.t for r in got.filter("k is null").collect()} == {10}
    shares = agg.share(hot.groupBy("k").agg(F.sum(F.abs("v")).alias("v")), "v", name="s")
    assert round(shares.agg(F.sum("s")).first()[0], 9) == 1


def test_keep_groups(spark, rows):
    df = inline_table(spark, [("a", 1), ("a", -1), ("b", 1), (None, 3)], "k string, v int")
    assert rows(filters.keep_groups(df, ["k"], "v")) == [(None, 3), ("b", 1)]


def test_total_row_recomputes_ratio(spark, rows):
    df = inline_table(spark, [("a", 1, 2), ("b", 3, 10)], "k string, x int, y int")
    cell = F.try_divide(F.sum("x"), F.sum("y"))
    assert rows(agg.with_total_row(df, "k", None, "Total", r=cell)) == [("Total", 0.333333), ("a", 0.5), ("b", 0.3)]


def test_total_row_keeps_null_label(spark, rows):
    df = inline_table(spark, [("a", 1), (None, 2)], "k string, x int")
    assert rows(agg.with_total_row(df, "k", None, "Total", n=F.sum("x"))) == [(None, 2), ("Total", 3), ("a", 1)]


def test_change_looks_back_to_last_reported_month(spark):
    df = inline_table(spark, [("2020-01-01", 10), ("2020-03-01", 15), ("2020-04-01", 0), ("2020-05-01", 3)], "date date, v int")
    got = {r.date: r.pct for r in agg.monthly_change(df, "v").collect()}
    assert got == {day(2020, 1): None, day(2020, 3): 0.5, day(2020, 4): -1.0, day(2020, 5): None}


def test_splices_do_not_overlap(spark):
    old = inline_table(spark, [(f"2020-{m:02d}-01", 1) for m in range(1, 9)], "date date, v bigint")
    new = inline_table(spark, [(f"2020-{m:02d}-01", 5) for m in range(6, 13)] + [("2020-12-01", 5)], "date date, v bigint")
    before = splice.splice_before(old, new)
    assert before.filter("v = 1").agg(F.max("date")).first()[0] == day(2020, 5)
    after = splice.splice_after(old, new, "v")
    assert after.groupBy("date").count().filter("count > 1").count() == 0
    assert after.filter("date = date'2020-12-01'").first().v == 10


def test_projection_flag(spark, rows):
    df = inline_table(spark, [("2024-05-01", 1), ("2024-06-01", 2)], "date date, v int")
    extra = inline_table(spark, [("2024-07-01", 9)], "date date, v int")
    got = rows(splice.append_projection(df, extra, "2024-06-01"), "v", "proj")
    assert got == [(1, False), (2, True), (9, True)]


def test_full_grid_hides_unreported(spark, rows):
    df = inline_table(spark, [(1, "a", 4), (2, "b", 5), (2, "a", None)], "s int, k string, v int")
    assert rows(reshape.full_grid(df, "s", "k", "v")) == [(1, "a", 4), (1, "b", 0), (2, "a", 0), (2, "b", 5)]
    assert rows(reshape.full_grid(df, "s", "k", "v", null_again="b")) == [(1, "a", 4), (1, "b", None), (2, "a", 0), (2, "b", 5)]


def test_densify_adds_listed_labels(spark, rows):
    df = inline_table(spark, [(1, "a", 4), (2, "b", 5)], "s int, k string, v int")
    got = rows(reshape.densify(df, ["s"], "k", ["a", "b", "c"], "v"))
    assert got == [(1, "a", 4), (1, "b", 0), (1, "c", 0), (2, "a", 0), (2, "b", 5), (2, "c", 0)]


def test_shift_left(spark, rows):
    df = inline_table(spark, [(None, 2, 3), (1, None, 3), (None, None, 9), (None, None, None)], "a int, b int, c int")
    assert rows(cleaning.shift_left(df, ["a", "b", "c"])) == [(None, None, None), (1, None, 3), (2, 3, None), (9, None, None)]


def test_lines_between_markers(spark, rows):
    texts = ["note", "País ene feb", "Haiti 1 2", "Otros 3 4", "Total 4 6", "Otros 9 9"]
    df = inline_table(spark, list(enumerate(texts)), "line bigint, text string")
    got = rows(cleaning.lines_between(df, "text", "line", "^País", "^Otros"), "text")
    assert got == [("Haiti 1 2",), ("Otros 3 4",), ("País ene feb",)]


def test_drop_zero_columns(spark):
    df = inline_table(spark, [(1, 0, 0, None), (2, 0, 3, None)], "k int, a int, b int, c int")
    assert cleaning.drop_zero_columns(df, but=["k"]).columns == ["k", "b"]


def test_drop_labels_keeps_null(spark, rows):
    df = inline_table(spark, [("Total general",), ("Peru",), (None,), ("all_other_x",)], "k string")
    assert rows(cleaning.drop_labels(df, "k", containing=["all_other"])) == [(None,), ("Peru",)]


def test_recode_known_spellings(spark):
    names = [("Irán, Rep. Islámica",), ("Corea, Rep. (Sur)",), ("Perú",), ("Chile",)]
    df = inline_table(spark, names, "k string")
    got = {r.k: r.x for r in df.select("k", cleaning.recode("k", cleaning.NAME_EXACT, cleaning.NAME_PARTS).alias("x")).collect()}
    assert list(got.values()) == ["Iran", "South Korea", "Peru", "Chile"]


def test_halve_repeats(spark, rows):
    df = inline_table(spark, [("a", 3), ("a", 3), ("b", 5)], "k string, v int")
    assert rows(agg.halve_repeats(df, ["k"], "v")) == [("a", 3.0), ("b", 5.0)]


def test_bind_columns_keeps_longer(spark, rows):
    a = inline_table(spark, [(1, "x"), (2, "y")], "pos int, a string")
    b = inline_table(spark, [(1, "p")], "pos int, b string")
    assert rows(joins.bind_columns(a, b, "pos")) == [(1, "x", "p"), (2, "y", None)]


def test_latest_two_of_single_month(spark):
    df = inline_table(spark, [("2024-01-01", 5)], "date date, v int")
    got = agg.latest_two(df, "v").first()
    assert (got.latest, got.difference) == (5, None)


def test_median_with_nan_and_infinity(spark):
    cells = [("a", 1.0), ("a", float("inf")), ("a", 5.0), ("b", float("-inf")), ("b", 2.0), ("c", float("nan")), ("c", 1.0), ("c", 3.0), ("d", None)]
    df = inline_table(spark, [(k, None if v is None else str(v)) for k, v in cells], "k string, v string").withColumn("v", F.col("v").cast("double"))
    got = {r.k: r.median for r in order.exact_median(df, "v", ["k"], total="all").collect()}
    assert got == {"a": 5.0, "b": float("-inf"), "c": 3.0, "all": 2.5}  # NaN counts as the largest value


def test_median_per_group_against_statistics(spark, hot):
    values = {}
    for r in hot.collect():
        values.setdefault(r.k, []).append(r.v)
    want = {k: statistics.median(v) for k, v in values.items()} | {"every": statistics.median([x for v in values.values() for x in v])}
    assert {r.k: r.median for r in order.exact_median(hot, "v", ["k"], total="every").collect()} == want


def test_fill_down_keeps_lines_without_number(spark, rows):
    cells = [(1, "a", "x"), (2, "a", None), (None, "a", None), (None, "a", "y"), (3, None, None), (1, None, "z")]
    df = inline_table(spark, cells, "line bigint, sheet string, label string")
    got = rows(order.fill_down(df, ["label"], "line", ["sheet"], size=1), "sheet", "line", "label")
    assert got == [(None, 1, "z"), (None, 3, "z"), ("a", None, None), ("a", None, "y"), ("a", 1, "x"), ("a", 2, "x")]


def test_median_of_a_million_groups(spark):
    df = spark.range(3_000_000).selectExpr("id % 1000000 as g", "cast(id div 1000000 + (id % 1000000) % 7 as double) as v")
    got = order.exact_median(df, "v", ["g"], total="0")
    wrong = got.filter("g is not null").filter("median != 1 + g % 7").count()
    assert got.count() == 1_000_001 and wrong <= 1  # the total is labelled 0 too


def test_median_cuts_blocks_with_many_values(spark, monkeypatch):
    monkeypatch.setattr(order, "MEDIAN_VALUES", 5)
    monkeypatch.setattr(order, "MEDIAN_CELLS", 4)
    rng = random.Random(4)
    rows = [(g, 1_000_000.0 + rng.random() ** 3 * (50 if g == "wide" else 0.001)) for g in ("wide", "narrow", None) for _ in range(701)]
    df = spark.createDataFrame([*rows, ("one", 3.0)], "g string, v double")
    want = {g: statistics.median([v for k, v in rows if k == g]) for g in ("wide", "narrow", None)} | {"one": 3.0}
    want["every"] = statistics.median([v for _, v in rows] + [3.0])
    assert {r.g: r.median for r in order.exact_median(df, "v", ["g"], total="every").collect()} == want
    whole = spark.createDataFrame([(v,) for _, v in rows], "v double")
    assert order.exact_median(whole, "v").first().median == statistics.median([v for _, v in rows])


def test_no_median_join_on_the_block_alone(spark):
    df = spark.createDataFrame([(f"g{i % 3}", float(i)) for i in range(50)], "g string, v double")
    seen = []
    real = order.landed
    order.landed = lambda frame, label: (seen.append(frame), real(frame, label))[1]
    try:
        order.exact_median(df, "v", ["g"], total="all").collect()
    finally:
        order.landed = real
    plans = "\n".join(f._jdf.queryExecution().optimizedPlan().toString() for f in seen)
    joins = [line for line in plans.splitlines() if "Join" in line]
    assert joins and all("_k0" in line and "_block" in line for line in joins)


def test_running_total_splits_one_value(spark):
    """Two thirds of the rows share a value: it lies in several blocks and the totals are those of one window."""
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("v"), (F.col("id") % 2).alias("g"))
    df = df.withColumn("v", F.when(F.col("id") % 1000 == 5, None).otherwise(F.col("v")))
    whole = Window.orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: (r.a, r.b) for r in df.select("id", F.sum("id").over(whole).alias("a"), F.count(F.lit(1)).over(Window.partitionBy("g").orderBy(F.desc("v"), "id").rowsBetween(Window.unboundedPreceding, 0)).alias("b")).collect()}
    a = {r.id: r.a for r in order.running_total_split(df, "id", [F.col("v"), F.col("id")], "a", parts=16).collect()}
    b = {r.id: r.b for r in order.running_total_split(df, F.lit(1).cast("long"), [F.desc("v"), F.col("id")], "b", ["g"], parts=16).collect()}
    assert a == {i: w[0] for i, w in want.items()} and b == {i: w[1] for i, w in want.items()}
    # without a tie-break every row of the value still has a place of its own
    places = order.running_total_split(df, F.lit(1).cast("long"), [F.col("v")], "n", parts=16)
    assert sorted(r.n for r in places.collect()) == list(range(1, 30_001))


def test_grid_of_a_long_spine(spark):
    """A day-grain spine of 100,000 values: no row holds them all."""
    df = spark.range(100_000).select(F.col("id").alias("s"), (F.col("id") % 3).alias("k"), F.lit(2).alias("v"))
    got = reshape.full_grid(df, "s", "k", "v")
    assert got.agg(F.count(F.lit(1)), F.sum("v"), F.count_distinct("s", "k")).first()[:] == (300_000, 200_000, 300_000)
