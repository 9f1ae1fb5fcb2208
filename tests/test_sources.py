"""Landed files: byte order mark, preamble, tags, ledger, snapshots and sheets."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.functions.numbers import amount, digits_only
from waymark.operators.cleaning import NAME_EXACT, NAME_PARTS, block_label, clean_names, rename_positions
from waymark.session import scratch_dir
from waymark.sources import delimited, dimensions, sheets, snapshots
from waymark.sources.delimited import inline_table


def test_read_table_with_mark_and_grouped_text(spark, tmp_path, rows):
    text = '﻿"FISCAL YEAR",Month,Total\n"FY 19",October,"51,005"\n"FY 19",November,X\n'
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    read = delimited.read_table(spark, str(tmp_path / "a.csv"))
    assert read.columns == ["fiscal_year", "month", "total"]
    assert rows(read)[1] == ("FY 19", "October", "51,005")


def test_read_with_preamble_and_quotes(spark, tmp_path, rows):
    notes = "Extracted from the portal, 2024\n" + "\n" * 12 + '"Country of origin, name",Year,n\n'
    (tmp_path / "p.csv").write_text(notes + '"Venezuela, Bol. Rep.",2023,"1,200"\nChile,2022,-\n')
    got = delimited.read_with_preamble(spark, str(tmp_path / "p.csv"), ["name", "year", "n"], "year", ["Country of origin, name", "Year", "n"])
    assert rows(got) == [("Chile", "2022", "-"), ("Venezuela, Bol. Rep.", "2023", "1,200")]


def test_read_tagged_takes_month_and_year_from_names(spark, tmp_path, rows):
    for name, n in (("MARCH 2023 - Issuances.csv", 4), ("APRIL 2024 - Issuances.csv", 6)):
        (tmp_path / name).write_text(f"Nationality,Visa Class,Issuances\nPeru,H2A,{n}\n")
    tags = {"month": r"/([A-Z]+) \d{4}", "year": r" (\d{4}) -"}
    got = delimited.read_tagged(spark, str(tmp_path), tags)
    assert rows(got) == [("Peru", "H2A", "4", "MARCH", "2023"), ("Peru", "H2A", "6", "APRIL", "2024")]


def test_unfold_pairs_with_quotes(spark, rows):
    df = inline_table(spark, [('1925,"22,199",1927,16393,1926,"12,735"',)], "text string")
    assert rows(delimited.unfold_pairs(df, "text", ("fy", "n"))) == [(1925, 22199), (1926, 12735), (1927, 16393)]


def test_numbered_lines(spark, tmp_path, rows):
    (tmp_path / "t.txt").write_text("0\tPaís  ene\n1\tHaiti 5\n")
    assert rows(delimited.read_lines(spark, str(tmp_path / "t.txt"))) == [(0, "País  ene"), (1, "Haiti 5")]


def test_gate_and_ledger(spark, rows):
    ledger = inline_table(spark, [("a", "2024-01-01"), ("b", None)], "dataset string, latest_date date")
    new = inline_table(spark, [("a", "2024-01-01"), ("b", "2023-01-01"), ("c", "2020-01-01")], "dataset string, new_date date")
    assert rows(snapshots.refresh_gate(ledger, new), "dataset", "refresh") == [("a", False), ("b", True), ("c", True)]
    done = inline_table(spark, [("b", "2023-01-01"), ("b", "2022-01-01")], "dataset string, latest_date date")
    got = rows(snapshots.ledger_update(ledger, done))
    assert got == [("a", dt.date(2024, 1, 1)), ("b", dt.date(2023, 1, 1))]


def test_failed_refresh_falls_back(spark, rows):
    schema = "dataset string, snapshot_date date, v int"
    stored = inline_table(spark, [("a", "2024-01-01", 1), ("a", "2024-02-01", 2), ("b", "2024-01-01", 3)], schema)
    live = inline_table(spark, [("b", "2024-03-01", 4)], schema)
    assert rows(snapshots.latest_good_snapshot(live, stored), "dataset", "v") == [("a", 2), ("b", 4)]


def test_snapshot_prunes_by_year(spark):
    df = inline_table(spark, [(f"{y}-01-01", y) for y in (2019, 2020, 2021)], "date date, v int")
    path = scratch_dir(spark, "test")
    snapshots.write_table(df, path, date="date")
    late = spark.read.parquet(path).filter(F.col("snapshot_year") >= 2021)
    assert late.count() == 1
    assert "PartitionFilters: [isnotnull(snapshot_year" in late._jdf.queryExecution().toString()


def test_dimensions(spark, rows):
    raw = inline_table(spark, [("Venezuela (Bolivarian Republic of)", "VE"), ("Peru", "PE")],
                       "official_name_en string, iso3166_1_alpha_2 string")
    assert rows(dimensions.country_codes(raw), "fips", "citizenship") == [("pe", "PERU"), ("ve", "VENEZUELA")]
    bank = inline_table(spark, [("Egypt, Arab Rep.", "SP.POP.TOTL", "5"), ("Peru", "OTHER", "9"), ("Chad", "SP.POP.TOTL", "..")],
                        "country_name string, series_code string, x2024_yr2024 string")
    assert rows(dimensions.population(bank, "x2024_yr2024")) == [("CHAD", None), ("EGYPT", 5)]


def test_agency_sheet(spark, rows):
    cells = [
        (1, "2023", "October", "1,000", "X", "9", "1,009"), (2, None, "January", "20", "7", "1", "28"),
        (3, None, "Total", "1,020", "7", "10", "1,037"), (4, "2024 (FYTD)", "October", "5", "6", "x", "11"),
        (5, "Counts before 2020 are provisional", "October", "1", "1", "1", "3"),
    ]
    schema = "line bigint, fiscal_year string, month string, el_salvador string, cuba string, all_other string, total string"
    got = rows(sheets.agency_sheet(inline_table(spark, cells, schema)))
    assert got == [
        (dt.date(2022, 10, 1), "EL SALVADOR", 1000), (dt.date(2023, 1, 1), "CUBA", 7),
        (dt.date(2023, 1, 1), "EL SALVADOR", 20), (dt.date(2023, 10, 1), "CUBA", 6), (dt.date(2023, 10, 1), "EL SALVADOR", 5),
    ]


def test_book_out_blocks_halve_repeated_rows(spark, rows):
    cells = [(1, "2024", "March", "9", "4", "8", "X"), (2, None, "March", "9", "4", "8", "3")]
    df = inline_table(spark, cells, "line bigint, fiscal_year string, month string, total_3 string, parole_4 string, total_5 string, parole_6 string")
    got = rows(sheets.book_out_sheet(sheets.book_out_cells(df), block_label("position", ["Cuba", "Peru"], 2, 3), "citizenship", halve=True))
    march = dt.date(2024, 3, 1)
    assert got == [(march, "Cuba", "parole", 4.0), (march, "Peru", "parole", 3.0)]


def test_budget_lines(spark, rows):
    cells = [(1, "Integration", None, None), (2, "Line A", "$1,000", "500"), (3, "Line B", "$0", None), (4, "Labor", None, None), (5, "Line C", "7", "")]
    df = inline_table(spark, cells, "line bigint, item string, fy_2023 string, fy_2024 string")
    got = rows(sheets.budget_lines(df, "item", ["Integration", "Labor"]), "cat", "op", "year", "value")
    assert got == [("Integration", "Line A", 2023, 1000), ("Integration", "Line A", 2024, 500), ("Labor", "Line C", 2023, 7), ("Labor", "Line C", 2024, None)]


def test_country_month_sheet_by_position(spark, rows):
    df = inline_table(spark, [("Honduras", "1,005", None), ("América", "9", "9"), (None, "1", "1")], "x1 string, sub1 string, sub2 string")
    named = rename_positions(clean_names(df), ["country_es", "Jan", "Feb"])
    got = rows(sheets.country_month_sheet(named, "country_es", ["Jan", "Feb"], 2024))
    assert got == [("Honduras", dt.date(2024, 1, 1), 1005), ("Honduras", dt.date(2024, 2, 1), 0)]


def test_preamble_reader_loses_no_record(spark, tmp_path, rows):
    body = 'Peru,2021,"1,5",x\nChile,"2,021"\n"Two\nlines",2022,3,\nCuba,2023\n'
    (tmp_path / "p.csv").write_text("Notes, 2024\n5,6,7,8\nName,Year,N,Mark\n" + body + "Source: us\n")
    columns = ["name", "year", "n", "mark"]
    got = rows(delimited.read_with_preamble(spark, str(tmp_path), columns, "year"))
    assert got == [("Chile", "2,021", None, None), ("Cuba", "2023", None, None), ("Peru", "2021", "1,5", "x"), ("Two\nlines", "2022", "3", None)]
    told = delimited.preamble_rows(spark, str(tmp_path), columns, "year").filter("not kept")
    assert told.count() == 4  # two notes, the header, the source line
    with pytest.raises(Exception, match="no header found"):
        delimited.read_with_preamble(spark, str(tmp_path), ["other", "year", "n", "mark"], "year").collect()


def test_files_with_other_headers_meet_by_name(spark, tmp_path, rows):
    (tmp_path / "JAN 2023.csv").write_text("country,visa,issuances\nPE,H2A,1\n")
    (tmp_path / "FEB 2023.csv").write_text("visa,country,issuances\nH2A,PE,2\n")
    (tmp_path / "MAR 2023.csv").write_text("country,issuances\nPE,10\n")
    got = delimited.read_tagged(spark, str(tmp_path), {"month": r"/([A-Z]+) \d{4}"})
    want = [("PE", None, "10", "MAR"), ("PE", "H2A", "1", "JAN"), ("PE", "H2A", "2", "FEB")]
    assert rows(got, "country", "visa", "issuances", "month") == want
    schema = StructType.fromDDL("country string, issuances int")
    assert rows(delimited.read_table(spark, str(tmp_path), schema)) == [("PE", 1), ("PE", 10), ("PE", 2)]
    with pytest.raises(Exception, match="nowhere"):
        delimited.read_table(spark, str(tmp_path), StructType.fromDDL("nowhere int"))


def test_csv_snapshot_with_date_keeps_every_row(spark, tmp_path, rows):
    df = inline_table(spark, [(f"{y}-01-01", y) for y in (2019, 2020, 2021)], "date date, v int")
    snapshots.write_table(df, str(tmp_path / "s"), date="date", fmt="csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert rows(back, "date", "v") == [("2019-01-01", "2019"), ("2020-01-01", "2020"), ("2021-01-01", "2021")]


def test_newest_snapshots_prune(spark, tmp_path, rows):
    schema = "dataset string, snapshot_date date, v int"
    for cells in ([("a", "2024-01-01", 1)], [("a", "2024-02-01", 2), ("b", "2024-01-01", 3)], [("a", "2024-02-01", 5)]):
        snapshots.land_snapshot(inline_table(spark, cells, schema), str(tmp_path / "s"))
    got = snapshots.newest_landed(spark, str(tmp_path / "s"))
    assert rows(got, "dataset", "v") == [("a", 5), ("b", 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(" in plan and "Join" not in plan


def test_scratch_folder_must_be_shared_off_one_machine(spark):
    class Remote:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Remote, "x")
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_sheet_totals_equal_output_totals(spark):
    cells = [(1, "FY 23", "October", "1,000", "20", "30", "1,050"), (2, None, "November", "2", "3", "4", "9"), (3, "2024 (FYTD)", "October", "5", "6", "7", "18"),
             (4, None, "Total", "1,007", "29", "41", "1,077"), (5, "1 As of March", None, None, None, None, None)]
    schema = "line bigint, fiscal_year string, month string, cuba string, peru string, all_other string, total string"
    df = inline_table(spark, cells, schema)
    kept = sheets.agency_sheet(df, residual=True)
    assert kept.agg(F.sum("encounter_count")).first()[0] == 1077
    assert {r.date for r in kept.select("date").distinct().collect()} == {dt.date(2022, 10, 1), dt.date(2022, 11, 1), dt.date(2023, 10, 1)}
    assert sheets.agency_sheet(df).agg(F.sum("encounter_count")).first()[0] == 1077 - 41


def test_amounts_keep_sign_and_decimals(spark, rows):
    cells = ["$1,234.50", "(5)", "-7", "1234.0", "($1,000)", " € 3 ", "", None, "12 people", "D", "1,2,3", ".5"]
    df = inline_table(spark, [(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = [r.v for r in df.select("i", amount("c").alias("v")).orderBy("i").collect()]
    assert got == [1234.5, -5, -7, 1234, -1000, 3, None, None, None, None, 123, 0.5]
    digits = [r.v for r in df.select("i", digits_only("c").alias("v")).orderBy("i").collect()]
    assert digits[0] is None and digits[2] is None and digits[3] is None and digits[1] == 5


def test_month_headers_with_years_and_recoded_names(spark, rows):
    df = inline_table(spark, [("Brasil", "1", "2"), ("Rep. Dominicana", "3", None), ("Dominicana, Rep.", "4", "5"), ("Total", "8", "7")], "pais string, jan22 string, ene_2023 string")
    got = rows(sheets.country_month_sheet(df, "pais", ["jan22", "ene_2023"], exact=NAME_EXACT, parts=NAME_PARTS))
    a, b = dt.date(2022, 1, 1), dt.date(2023, 1, 1)
    assert got == [("Brazil", a, 1), ("Brazil", b, 2), ("Dominican Republic", a, 7), ("Dominican Republic", b, 5)]


def year_sheet(spark, rows):
    cells = [(label, month, i, "7") for i, (label, month) in enumerate(rows)]
    return inline_table(spark, cells, "fiscal_year string, month string, line bigint, cuba string")


def years_of(spark, rows, **options):
    got = sheets.agency_sheet(year_sheet(spark, rows), **options).orderBy("date").collect()
    return [r.date.isoformat()[:7] for r in got]


@pytest.mark.parametrize("second", ["2024*", "Fiscal Year 2024", "2024 YTD", "FY24", " 2024 (FYTD) ", "2024 revised in 2025"])
def test_labels_of_any_wording_start_their_year(spark, second):
    rows = [("2023", "October"), (None, "November"), (None, "Total"), (second, "October"), ("", "November"), (None, "December")]
    assert years_of(spark, rows) == ["2022-10", "2022-11", "2023-10", "2023-11", "2023-12"]


@pytest.mark.parametrize("step", [1, -1])
def test_missing_and_unreadable_labels_are_counted_from_their_neighbours(spark, step):
    year = lambda k: str(2020 + step * k)
    rows = [(year(0), "October"), (None, "May"), (None, "October"), (None, "May"), ("see note", "October"), (None, "May"), (year(3), "October")]
    want = [f"{2020 + step * k - (m == 10)}-{m:02d}" for k in range(4) for m in (10, 5) if (k, m) != (3, 5)]
    assert years_of(spark, rows) == sorted(want)


@pytest.mark.parametrize(
    "rows",
    [
        [("2023", "October"), (None, "November"), (None, "October")],  # a year without a label at the end
        [("2023", "October"), ("n/a", "November")],  # an unreadable label, no other to count from
        [("2022", "October"), (None, "May"), (None, "October"), (None, "May"), ("2025", "October")],  # two starts, three years
        [(None, "May"), ("2023", "October")],  # no label before the first start
        [("2023", "October"), (None, "May"), (None, "October"), ("Ending in autumn", "May"), ("2026", "October")],
        [("2023", "October"), (None, "May"), ("2023", "October")],  # a year that repeats the label of the last one
        [("2023", "October"), (None, "May"), ("2023", ""), (None, "October")],  # a year total taken for a label
        [("12345", "October")],  # not a year
    ],
)
def test_years_that_stay_unknown_fail(spark, rows):
    with pytest.raises(Exception, match="at line"):
        years_of(spark, rows)


def test_labels_on_their_own_rows_and_notes(spark):
    rows = [("Agency encounters, 2019 edition", None), ("FY 2023", ""), (None, "October"), (None, "May"), ("Source: agency 2020", ""), (None, "June"), ("2024", None), (None, "October")]
    assert years_of(spark, rows) == ["2022-10", "2023-05", "2023-06", "2023-10"]
    late = [(None, "October"), ("2024", "November"), (None, "March")]
    assert years_of(spark, late) == ["2023-10", "2023-11", "2024-03"]


def test_years_across_line_blocks_and_sheets(spark, monkeypatch):
    """Starts, labels and gaps meet over the borders of blocks; sheets and rows without a line stay apart."""
    monkeypatch.setattr(sheets, "line_block", lambda line: F.floor(F.col(line) / 3).cast("long"))
    real = sheets.nearest
    monkeypatch.setattr(sheets, "nearest", lambda *a, **k: real(*a, **k, size=3))
    names = ["October", "January", "March", "July"]
    cells, want = [], []
    for name, first in (("a", 2001), ("b", 2011), (None, 2021)):
        for k in range(8):
            for i, month in enumerate(names):
                label = str(first + k) if i == 0 and k not in (2, 3, 5) else None
                cells.append((name, label, month, k * 4 + i, "1"))
                want.append((name, first + k - (i == 0), {"October": 10, "January": 1, "March": 3, "July": 7}[month]))
    cells.append(("a", "1990", "May", None, "1"))
    want.append(("a", 1990, 5))
    df = inline_table(spark, cells, "sheet string, fiscal_year string, month string, line bigint, cuba string").repartition(5)
    got = sheets.agency_sheet(df, by=["sheet"]).collect()
    assert sorted((str(r.sheet), r.date.year, r.date.month) for r in got) == sorted((str(n), y, m) for n, y, m in want)


def test_interrupted_or_changed_snapshots_are_passed_over(spark, rows):
    path = scratch_dir(spark, "commits")
    with pytest.raises(Exception):
        snapshots.newest_committed(spark, path)
    frame = lambda v, extra="": inline_table(spark, [(v, "x")], f"v int, note{extra} string")
    for day, v in (("2024-01-01", 1), ("2024-02-01", 2), ("2024-03-01", 3)):
        snapshots.commit_snapshot(frame(v), path, "a", day)
    snapshots.commit_snapshot(frame(9, "2"), path, "b", "2024-01-01")
    snapshots.commit_snapshot(frame(10, "2"), path, "b", "2024-01-01")  # landed again
    snapshots.commit_snapshot(frame(0).limit(0), path, "empty", "2024-01-01")
    frame(4).write.parquet(f"{path}/a-2024-04-01-x")  # no manifest
    assert rows(snapshots.newest_committed(spark, path), "dataset", "v", "note", "note2") == [("a", 3, "x", None), ("b", 10, None, "x")]
    lines = {str(m.snapshot_date): m.folder for m in snapshots.manifests(spark, path).filter("dataset = 'a'").collect()}
    frame(5).write.mode("overwrite").parquet(f"{path}/{lines['2024-03-01']}")  # other rows under the manifest
    fs, folder = snapshots._filesystem(spark, f"{path}/{lines['2024-02-01']}")
    for status in fs.listStatus(folder):  # files that are gone
        if status.getPath().getName().endswith(".parquet"):
            fs.delete(status.getPath(), False)
    assert rows(snapshots.newest_committed(spark, path).filter("dataset = 'a'"), "snapshot_date", "v") == [(dt.date(2024, 1, 1), 1)]
    # a manifest that was cut off says nothing
    snapshots._create(spark, f"{path}/{snapshots.MANIFESTS}/99999999999999999999-x.json", '{"dataset": "a", "snapsh')
    assert snapshots.manifests(spark, path).count() == 5


def test_two_writers_lose_no_ledger_entry(spark, rows):
    from concurrent.futures import ThreadPoolExecutor

    path = scratch_dir(spark, "ledger")
    assert snapshots.read_ledger(spark, path).collect() == []
    entry = lambda name, day: inline_table(spark, [(name, day)], "dataset string, latest_date string").withColumn("latest_date", F.to_date("latest_date"))
    names = [f"d{i}" for i in range(6)]
    with ThreadPoolExecutor(3) as pool:
        versions = list(pool.map(lambda n: snapshots.commit_ledger(spark, entry(n, "2024-05-01"), path), names))
    assert sorted(versions) == list(range(1, 7))
    assert rows(snapshots.read_ledger(spark, path)) == [(n, dt.date(2024, 5, 1)) for n in names]
    snapshots.commit_ledger(spark, entry("d0", "2023-01-01"), path)
    assert rows(snapshots.read_ledger(spark, path))[0] == ("d0", dt.date(2024, 5, 1))
    stale = snapshots.ledger_version(spark, path) - 1
    with pytest.raises(snapshots.Conflict):
        snapshots.write_ledger(entry("x", "2024-01-01"), path, stale)


def test_wrong_records_are_told_apart(spark, tmp_path, rows):
    (tmp_path / "jan 2024.csv").write_text('Name,Count,Day\n"A, B",1,2024-01-01\nC,,\nD,1.5x,soon\nE,3\nF,4,2024-01-02,more\n')
    (tmp_path / "feb 2024.csv").write_text("\ufeffDay,Name\n2024-02-01,G\n")
    kinds = StructType.fromDDL("name string, count int, day date")
    got = delimited.checked_table(spark, str(tmp_path), kinds, {"month": r"([a-z]+) \d{4}\.csv"})
    assert rows(delimited.accepted(got)) == [
        ("A, B", 1, dt.date(2024, 1, 1), "jan"), ("C", None, None, "jan"), ("G", None, dt.date(2024, 2, 1), "feb"),
    ]
    bad = {r.name: (r["_record"], r["_reasons"]) for r in delimited.rejected(got).collect()}
    assert bad == {"D": (None, ["count", "day"]), "E": ("E,3", ["cells"]), "F": ("F,4,2024-01-02,more", ["cells"])}
    assert rows(delimited.reject_counts(got, ["month"])) == [("feb", 1, 0, None, 0), ("jan", 2, 3, "cells", 2), ("jan", 2, 3, "count", 1), ("jan", 2, 3, "day", 1)]
    per_file = delimited.reject_counts(got).groupBy("_file").count().collect()
    assert sorted(r["_file"].rsplit("/", 1)[1] for r in per_file) == ["feb 2024.csv", "jan 2024.csv"]


def test_records_of_a_file_read_in_many_splits(spark, tmp_path):
    """Cells with line breaks, doubled and stray quotes: the same records as one task finds, wherever the splits fall."""
    draw = random.Random(5)
    cells = ['"a\nb"', '"two ""words""\n\n, 1"', "plain", "5\" wide", '""', '"x"', '" \n"', "", '"' + "long, " * 40 + '\n"']
    lines = ["Notes on the table", 'in "quotes", and more', "", "Name,Text,n"]
    lines += [f"row {i},{draw.choice(cells)},{i}" for i in range(3000)] + ["Source: registers"]
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.csv").write_bytes("\r\n".join(["Name,Text,n", 'first,"c\r\nd",1', "second,é,2"]).encode())
    names = ["name", "text", "n"]
    asked = spark.read.schema("name string, text string, n string").option("quote", '"').option("escape", '"')
    a = [tuple(r) for r in asked.option("multiLine", True).csv(str(tmp_path / "a.csv")).collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("2500", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            if size == "2500":
                assert delimited.file_lines(spark, str(tmp_path)).select("_file", "_block").distinct().count() > 50
            got = delimited.preamble_rows(spark, str(tmp_path / "a.csv"), names, "n").collect()
            assert Counter(tuple(r)[:3] for r in got) == Counter(a)
            assert sum(r["kept"] for r in got) == 3000
        both = delimited.read_with_preamble(spark, str(tmp_path), names, "n").filter("name in ('first', 'second')").collect()
        assert sorted(tuple(r) for r in both) == [("first", "c\nd", "1"), ("second", "é", "2")]
        at = [r["_at"] for r in delimited.file_records(spark, str(tmp_path / "a.csv")).orderBy("_at").collect()]
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert at == [r["_at"] for r in delimited.file_records(spark, str(tmp_path / "a.csv")).orderBy("_at").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
