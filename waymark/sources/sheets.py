"""One normaliser per sheet shape. Input cells are text; output is tidy and typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.calendar import calendar_year, header_year, label_year, month_number, month_start
from waymark.functions.numbers import amount, parse_number, unsuppress
from waymark.functions.text import strip_position, underscores_to_blanks
from waymark.operators.aggregates import halve_repeats
from waymark.operators.cleaning import drop_labels, recode
from waymark.operators.filters import keep_groups
from waymark.operators.order import fill_down, line_block, nearest, running_total
from waymark.operators.reshape import to_long
from waymark.session import landed

#: What a fiscal year label on a row of its own looks like (``2019``, ``FY 19``, ``Fiscal Year 2024 (FYTD)``, ``2024*``);
#: any other text on a row without a month is a note.
FISCAL_LABEL = r"^(?i)\s*(fy|fiscal year)?\s*'?(\d{2}|\d{4})\s*[*†]*\s*(ytd|\([^)]*\))?\s*[*†]*\s*$"
#: Text beside a month that is a note too: five words or more that don't begin with a year.
SENTENCE = r"^(?i)(?!\s*(fy|fiscal year|year)?\s*'?\d)\s*(\S+\s+){4}\S"


def fiscal_years(sheet: DataFrame, line: str = "line", by: list[str] | None = None, century: int = 2000) -> DataFrame:
    """The month rows of a sheet with the fiscal year of each in ``_fy`` and its month number in ``_m``.

    The order of the months tells where a year starts: at each row whose month comes earlier in the fiscal year (October
    to September) than that of the month row before; the same month again is a repeated row. Labels tell which year it
    is, and both must agree:

    * a label on a month row holds for it, whatever text surrounds its year; one on a row of its own (``FISCAL_LABEL``,
      blank month) holds for the next month row. Other rows without a month name are notes or totals and say nothing, and
      so does a month row with a ``SENTENCE`` in place of the label, which goes;
    * a row without a label belongs to the year of the last label, as long as no year started since and no label since
      was unreadable;
    * years without a readable label are counted from the labels around them, if the starts between two labels are as
      many as the years between them (rising or falling);
    * months before the first label belong to its year if no year starts in between;
    * a month row whose year stays unknown, and a label that repeats the year of the last one after a new year has
      started, fail the job with their line.

    ``by`` names the sheet. Each line number may come once in a sheet, else the job fails; a row without one needs its own
    label. The labels and months, without the cells, are written to the shared folder and worked on in blocks of lines;
    the cells are joined once.
    """
    by, placed = list(by or []), F.col(line).isNotNull()
    keys = [f"_by{i}" for i in range(len(by))]
    named = {k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for k, c in zip(keys, by)}
    text = F.nullif(F.trim("fiscal_year"), F.lit(""))
    alone = F.coalesce(F.trim("month"), F.lit("")) == ""
    rows = sheet.withColumns({**named, "_m": month_number("month"), "_text": text, "_line": F.col(line).cast("bigint")})
    rows = rows.filter(~F.coalesce(F.col("_m").isNotNull() & F.col("_text").rlike(SENTENCE), F.lit(False)))
    spoken = F.col("_m").isNotNull() | (alone & F.col("_text").rlike(FISCAL_LABEL))
    rows = rows.withColumn("_label", F.when(spoken, label_year("_text", century)))
    where = F.concat(F.lit(" at line "), F.coalesce(F.col("_line").cast("string"), F.lit("without a number")))
    unknown = F.raise_error(F.concat(F.lit("no fiscal year is known"), where)).cast("int")
    # only month rows and labels of their own matter to the order
    order = rows.filter(placed & (F.col("_m").isNotNull() | F.col("_label").isNotNull()))
    order = landed(order.select(*keys, "_line", "_m", "_label", "_text"), "order")

    place = (F.col("_m") + 2) % 12  # October is 0
    order = nearest(
        order,
        "_line",
        strictly={
            "_last": F.when(F.col("_m").isNotNull(), F.struct("_line", place.alias("place"))),
            "_above": F.when(F.col("_m").isNull(), F.struct("_line", F.col("_label").alias("year"))),
        },
        by=keys,
    ).filter(F.col("_m").isNotNull())
    pending = F.when(F.coalesce(F.col("_above._line") > F.col("_last._line"), F.lit(True)), F.col("_above.year"))
    unreadable = F.col("_text").isNotNull() & F.col("_label").isNull()
    starts = F.coalesce(place < F.col("_last.place"), F.lit(False)).cast("int")
    label = F.when(~unreadable, F.coalesce("_label", pending))
    order = order.select(*keys, "_line", label.alias("_label"), unreadable.alias("_bad"), starts.alias("_new"))
    order = landed(running_total(order, "_new", ["_line"], line_block("_line"), "_run", keys), "order")

    known = F.when(F.col("_label").isNotNull(), F.struct("_line", F.col("_label").alias("year"), F.col("_run").alias("run")))
    broken = F.when(F.col("_bad"), F.col("_line"))
    order = nearest(order, "_line", {"_from": known, "_broken": broken}, {"_to": known}, {"_before": known}, keys)
    gone, span = F.col("_run") - F.col("_from.run"), F.col("_to.year") - F.col("_from.year")
    between = F.col("_to.run") - F.col("_from.run")
    same_year = (gone == 0) & ~F.coalesce(F.col("_broken") >= F.col("_from._line"), F.lit(False))
    found = (
        F.when(F.col("_label").isNotNull(), F.col("_label"))
        .when(same_year, F.col("_from.year"))
        .when(between == span, F.col("_from.year") + gone)
        .when(between == -span, F.col("_from.year") - gone)
        .when(F.col("_from").isNull() & (F.col("_to.run") == F.col("_run")) & F.col("_broken").isNull(), F.col("_to.year"))
    ).cast("int")
    repeated = F.coalesce((F.col("_label") == F.col("_before.year")) & (F.col("_run") > F.col("_before.run")), F.lit(False))
    again = F.raise_error(F.concat(F.lit("a new fiscal year repeats the label of the last one"), where)).cast("int")
    dated = order.select(*keys, "_line", F.when(repeated, again).otherwise(F.coalesce(found, unknown)).alias("_fy"))
    twice = F.raise_error(F.concat(F.lit("two rows"), where)).cast("int")
    dated = dated.groupBy(*keys, "_line").agg(F.count(F.lit(1)).alias("_n"), F.max("_fy").alias("_fy"))
    dated = dated.select(*keys, "_line", F.when(F.col("_n") > 1, twice).otherwise(F.col("_fy")).alias("_fy"))
    # a row without a line meets none and has its own label only
    whole = rows.filter(F.col("_m").isNotNull()).join(dated.withColumnRenamed("_fy", "_found"), [*keys, "_line"], "left")
    year = F.coalesce("_found", F.when(~placed, F.col("_label")), unknown)
    return whole.select(*[F.col(f"`{c}`") for c in sheet.columns], "_m", year.alias("_fy"))


def _fiscal_months(sheet: DataFrame, line: str, by: list[str] | None, century: int) -> DataFrame:
    """The month rows of a sheet, dated by their fiscal year and month."""
    rows = fiscal_years(sheet, line, by, century)
    return rows.withColumn("date", month_start(calendar_year("_fy", "_m"), "_m")).drop("fiscal_year", "month", line, "_m", "_fy")


def agency_sheet(
    sheet: DataFrame,
    key: str = "citizenship",
    value: str = "encounter_count",
    line: str = "line",
    by: list[str] | None = None,
    century: int = 2000,
    residual: bool = False,
) -> DataFrame:
    """Month rows by category columns -> one row per month and category.

    The fiscal year stands only in the first row of each year. Total rows and the column ``total`` are dropped, and
    ``all_other...`` too unless ``residual`` keeps it; suppressed cells give no row, names become upper case with blanks.
    """
    rows = _fiscal_months(sheet, line, by, century)
    ids = ["date", *(by or [])]
    columns = [c for c in rows.columns if c not in ids and c != "total" and (residual or "all_other" not in c)]
    long = to_long(rows, ids, columns, key, value)
    named = F.upper(underscores_to_blanks(strip_position(key)))
    return long.select(*ids, named.alias(key), unsuppress(value).cast("bigint").alias(value)).dropna(subset=[value])


def book_out_cells(sheet: DataFrame, line: str = "line", century: int = 2000) -> DataFrame:
    """Month rows by repeated column blocks (``category_position``) -> month, position, category, count."""
    rows = _fiscal_months(sheet, line, None, century)
    columns = [c for c in rows.columns if c != "date"]
    long = to_long(rows, ["date"], columns, "_name", "_cell")
    position = F.regexp_extract("_name", r"_(\d+)$", 1).try_cast("int")
    cells = long.select("date", position.alias("position"), strip_position("_name").alias("cat"), unsuppress("_cell").alias("count"))
    return cells.filter(F.col("count").isNotNull())


def book_out_sheet(cells: DataFrame, label: Column, name: str, halve: bool = False) -> DataFrame:
    """Cells of ``book_out_cells`` -> month, block label, category, count.

    ``label`` maps the column ``position`` to the block's label; total blocks and total categories are dropped. Several
    layouts of one sheet can share its cells.
    """
    tidy = cells.select("date", label.alias(name), "cat", "count")
    tidy = tidy.filter((F.col(name) != "Total") & ~F.col("cat").contains("total"))
    keys = ["date", name, "cat"]
    return halve_repeats(tidy, keys, "count") if halve else tidy.groupBy(*keys).agg(F.sum("count").alias("count"))


def book_out_by_agency(cells: DataFrame, total: str = "total_encounters") -> DataFrame:
    """Cells of a sheet without blocks -> month, category (agency), count; only the column ``total`` is dropped."""
    tidy = cells.filter(F.col("cat") != total)
    return tidy.groupBy("date", "cat").agg(F.sum("count").alias("count"))


def country_month_sheet(
    sheet: DataFrame,
    label: str,
    months: list[str],
    year=None,
    value: str = "encounter_count",
    name: Column | None = None,
    exact: dict[str, str] | None = None,
    parts: dict[str, str] | None = None,
    century: int | None = None,
) -> DataFrame:
    """Country rows by month columns -> one row per country and month.

    Total and region rows are dropped; ``year`` is a number, a column, or None where the month headers carry it
    (``jan22``); blank cells count 0. With ``exact`` or ``parts`` the spellings are recoded, and countries that then
    share a name are summed.
    """
    rows = drop_labels(sheet.filter(F.col(label).isNotNull()), label)
    ids = [label, year] if isinstance(year, str) else [label]
    long = to_long(rows.select(*ids, *months), ids, months, "_month", "_cell")
    y = header_year("_month", century) if year is None else F.col(year) if isinstance(year, str) else F.lit(year)
    named = name if name is not None else F.col(label)
    out = long.select(
        recode(named, exact, parts).alias("citizenship"),
        month_start(y, month_number("_month")).alias("date"),
        F.coalesce(F.round(amount("_cell")), F.lit(0)).cast("bigint").alias(value),
    )
    return out.groupBy("citizenship", "date").agg(F.sum(value).alias(value)) if exact or parts else out


def budget_lines(sheet: DataFrame, label: str, parents: list[str], line: str = "line") -> DataFrame:
    """Parent labels filled down to their child lines, year columns as numbers, all-zero lines dropped."""
    marked = sheet.withColumn("cat", F.when(F.col(label).isin(parents), F.col(label)))
    rows = fill_down(marked, ["cat"], line).filter(F.col("cat") != F.col(label)).drop(line)
    columns = [c for c in rows.columns if c not in ("cat", label)]
    long = to_long(rows, ["cat", label], columns, "_year", "_cell")
    tidy = long.select(
        "cat",
        F.col(label).alias("op"),
        parse_number("_year").cast("int").alias("year"),
        amount("_cell").alias("value"),
    )
    return keep_groups(tidy, ["cat", "op"], "value")


def admissions_sheet(sheet: DataFrame, months: list[str], year: str = "year", label: str | None = None) -> DataFrame:
    """Fiscal-month columns (``oct`` ... ``sep``) with the fiscal year as text -> monthly series."""
    ids = [year, *([label] if label else [])]
    long = to_long(sheet.select(*ids, *months), ids, months, "_month", "_cell")
    keys = ["date", *([label] if label else [])]
    parsed = long.withColumns({"_m": month_number("_month"), "_fy": amount(year).cast("int")})
    date = month_start(calendar_year("_fy", "_m"), "_m")
    tidy = parsed.select(date.alias("date"), *([label] if label else []), F.round(amount("_cell")).cast("bigint").alias("value"))
    return tidy.groupBy(*keys).agg(F.sum("value").alias("value"))
