"""Column functions on hand-made values."""

import datetime as dt

from pyspark.sql import functions as F

from waymark.functions import calendar as cal
from waymark.functions import labels, numbers, text
from waymark.sources.delimited import inline_table


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_fiscal_year_turns_in_october(spark):
    days = {"2023-09-01": 2023, "2023-10-01": 2024, "2024-01-01": 2024}
    for day, year in days.items():
        assert one(spark, cal.fiscal_year(F.lit(day).cast("date")), a=1) == year
    assert one(spark, cal.fiscal_year(F.lit(None).cast("date")), a=1) is None


def test_fiscal_labels(spark):
    for label, year in {"FY 19": 2019, "2024 (FYTD)": 2024, "2023": 2023, "note": None}.items():
        assert one(spark, cal.parse_fiscal_label("a"), a=label) == year


def test_months_in_two_languages(spark):
    for label, month in {"Enero": 1, "ago": 8, "DIC": 12, "September": 9, "Septiembre": 9, "total": None}.items():
        assert one(spark, cal.month_number("a"), a=label) == month


def test_calendar_year_of_fiscal_month(spark):
    assert one(spark, cal.calendar_year("fy", "m"), fy=2024, m=11) == 2023
    assert one(spark, cal.calendar_year("fy", "m"), fy=2024, m=3) == 2024


def test_fiscal_month_order(spark):
    got = [one(spark, cal.fiscal_month_order("m"), m=m) for m in (10, 12, 1, 9)]
    assert got == [-2, 0, 1, 9]


def test_anchored_year_steps_stay_inside(spark):
    bounds = inline_table(spark, [("1999-06-01", "2010-03-01")], "a date, z date")
    got = sorted(r.date for r in cal.anchored_year_steps(bounds, "a", "z", 5).collect())
    assert got == [dt.date(2000, 3, 1), dt.date(2005, 3, 1), dt.date(2010, 3, 1)]


def test_epoch_day(spark):
    assert one(spark, cal.from_epoch_day("n"), n=20028) == dt.date(2024, 11, 1)


def test_parse_number(spark):
    for cell, value in {"1,234,567": 1234567, "(1,234)": 1234, "$ 12.5": 12.5, "X": None, "": None, "-3": -3}.items():
        assert one(spark, numbers.parse_number("a"), a=cell) == value


def test_digits_only_strips_every_separator(spark):
    for cell, value in {"1,234,567": 1234567, "  ": None, "12*": 12, "abc": None}.items():
        assert one(spark, numbers.digits_only("a"), a=cell) == value


def test_suppressed_cells(spark):
    for cell, value in {"X": None, " D ": None, "-": None, "1,000": 1000}.items():
        assert one(spark, numbers.unsuppress("a"), a=cell) == value


def test_zero_base_gives_null(spark):
    assert one(spark, numbers.ratio("a", "b"), a=3, b=0) is None
    assert one(spark, numbers.change("a", "b"), a=3, b=0) is None
    assert one(spark, numbers.compound_growth("a", "b", F.lit(3)), a=0, b=5) is None
    assert one(spark, numbers.zero_to_null("a"), a=float("inf")) is None


def test_signed_root(spark):
    assert round(one(spark, numbers.signed_root("a"), a=-27.0), 9) == -3


def test_sums_over_nothing(spark):
    df = inline_table(spark, [("a", 1), ("a", None), ("b", None)], "k string, v int")
    got = {
        r.k: (r.strict, r.some, r.mean)
        for r in df.groupBy("k").agg(
            numbers.strict_sum("v").alias("strict"),
            numbers.sum_where("v", F.col("v") > 5).alias("some"),
            numbers.mean_where("v", F.col("v") > 5).alias("mean"),
        ).collect()
    }
    assert got == {"a": (None, 0, None), "b": (None, 0, None)}


def test_title_case_breaks_on_punctuation(spark):
    assert one(spark, text.title_case("a"), a="TIMOR-LESTE (EAST)") == "Timor-Leste (East)"
    assert one(spark, text.title_case("a"), a="a b") == "A B"


def test_accents_and_commas(spark):
    assert one(spark, text.fold_accents("a"), a="Perú Ñandú Ž") == "Peru Nandu Z"
    assert one(spark, text.before_last_comma("a"), a="Congo, Dem., Rep.") == "Congo, Dem."
    assert one(spark, text.before_first_comma("a"), a="Congo, Dem., Rep.") == "Congo"
    assert one(spark, text.before_last_comma("a"), a="Peru") == "Peru"


def test_footnotes(spark):
    assert one(spark, text.strip_footnotes("a"), a="Brasil (1)") == "Brasil"
    assert one(spark, text.strip_footnotes("a"), a="total_12") == "total"
    assert one(spark, text.strip_position("a"), a="book_outs2_31") == "book_outs"


def test_header_names():
    names = ["﻿AÑO1", "Count of Encuesta_Public.sav", "ImageURL", "IDPs of concern", "2024", "", "Total", "Total"]
    assert text.snake_all(names) == [
        "ano1", "count_of_encuesta_public_sav", "image_url", "id_ps_of_concern", "x2024", "x", "total", "total_2",
    ]


def test_labels(spark):
    assert one(spark, labels.unit_label("v", F.lit(2_300_000)), v=2_300_000) == "2.3M"
    assert one(spark, labels.unit_label("v", F.lit(2_300_000)), v=450_000) == "0.45"
    assert one(spark, labels.unit_label("v", F.lit(12_000)), v=12_000) == "12K"
    assert one(spark, labels.unit_label("v", F.lit(900)), v=900) == "900"
    assert one(spark, labels.percent_label("v", 1), v=0.1234) == "12.3%"
    assert one(spark, labels.significant("v"), v=0.0) == 0.0
