"""Delimited text sources. All cells are read as text; cleaning operators type them."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from waymark.functions.numbers import amount
from waymark.functions.text import snake_all
from waymark.session import landed


def _reader(spark: SparkSession):
    return spark.read.option("quote", '"').option("escape", '"').option("recursiveFileLookup", True)


def headers(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """Header line -> files that start with it. The driver gets one row per file, as when it lists them."""
    lines = spark.read.option("recursiveFileLookup", True).text(paths)
    heads = lines.filter("_metadata.file_block_start = 0").select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at")
    )
    first = heads.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    out: dict[str, list[str]] = {}
    for row in first.collect():
        out.setdefault(row["header"], []).append(unquote(row["file"]))
    return {h: sorted(out[h]) for h in sorted(out)}


def _by_header(spark: SparkSession, paths: str | list[str], pick) -> DataFrame:
    """One read per distinct header, united by name; ``pick`` selects from a read and its snake_case names."""
    out = None
    for files in headers(spark, paths).values():
        raw = _reader(spark).option("header", True).option("enforceSchema", False).csv(files)
        part = pick(raw, snake_all(raw.columns))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no file with a header under {paths}")
    return out


def read_table(spark: SparkSession, paths: str | list[str], schema: StructType | None = None) -> DataFrame:
    """CSV with a header; names become snake_case and a byte order mark is dropped.

    Files may differ in the order and number of their columns: they meet by name, and a column that a file lacks is
    null. With a schema the columns are picked by name and cast; a cell that does not parse gives null, and a column
    that no file has is an error.
    """
    named = _by_header(spark, paths, lambda raw, names: raw.toDF(*names))
    if schema is None:
        return named
    return named.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


#: Names that ``checked_table`` adds to the columns of the schema.
RECORD, REASONS, FILE, RAGGED = "_record", "_reasons", "_file", "cells"


def checked_table(spark: SparkSession, paths: str | list[str], schema: StructType, tags: dict[str, str] | None = None) -> DataFrame:
    """Every record of CSV files with a header, typed, with what is wrong with it: nothing is dropped or silently null.

    Columns meet by snake_case name and are cast as ``schema`` says; ``tags`` come from the file path as in
    ``read_tagged``. ``_reasons`` holds ``cells`` where a record has more or fewer cells than its header, and the name of
    each column whose cell is neither blank nor of its type; it is empty for a good record. ``_record`` is the text of a
    record with a wrong number of cells, ``_file`` the file. A column that one file lacks is null and no fault; one that
    no file has is an error. Files are read in splits, so records must not hold line breaks.
    """

    def pick(raw: DataFrame, names: list[str]) -> DataFrame:
        files = [unquote(f) for f in raw.inputFiles()]
        kinds = StructType([*(StructField(f"c{i}", StringType()) for i in range(len(names))), StructField(RECORD, StringType())])
        again = _reader(spark).schema(kinds).option("header", True).option("columnNameOfCorruptRecord", RECORD).csv(files)
        path = F.url_decode(F.col("_metadata.file_path"))
        made = [F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias(tag) for tag, pattern in (tags or {}).items()]
        return again.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], *made, path.alias(FILE), RECORD)

    cells = _by_header(spark, paths, pick)
    typed, wrong = [], [F.when(F.col(RECORD).isNotNull(), F.lit(RAGGED))]
    for f in schema.fields:
        cell = F.col(f"`{f.name}`")
        value = cell.try_cast(f.dataType)
        typed.append(value.alias(f.name))
        wrong.append(F.when(value.isNull() & (F.trim(cell) != ""), F.lit(f.name)))
    return cells.select(*typed, *(tags or {}), FILE, RECORD, F.array_compact(F.array(*wrong)).alias(REASONS))


def accepted(checked: DataFrame) -> DataFrame:
    """The good records of ``checked_table``, without the columns that say so."""
    return checked.filter(F.size(REASONS) == 0).drop(RECORD, REASONS, FILE)


def rejected(checked: DataFrame) -> DataFrame:
    """The other records, with file, reasons and, where cells are missing or too many, the text."""
    return checked.filter(F.size(REASONS) > 0)


def reject_counts(checked: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per file (or ``by``): ``kept`` and ``rejected`` records, and one row per reason with its ``records``.

    Files without a fault have one row with a null reason; a record with two faults counts for both reasons.
    """
    keys = by or [FILE]
    good = F.size(REASONS) == 0
    per_file = checked.groupBy(*keys).agg(F.count_if(good).alias("kept"), F.count_if(~good).alias("rejected"))
    reasons = checked.select(*keys, F.explode(REASONS).alias("reason")).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("records"))
    on = None
    for k in keys:
        same = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = same if on is None else on & same
    joined = per_file.alias("l").join(reasons.alias("r"), on, "left")
    return joined.select(*[F.col(f"l.{k}") for k in keys], "kept", "rejected", "reason", F.coalesce("records", F.lit(0)).alias("records"))


#: Where a quote stands: before the first quote of a line, outside a cell in quotes, inside one, just after its end.
_START, _OUTSIDE, _INSIDE, _CLOSED = range(4)


def _still_open(line: str, entry: int) -> Column:
    """Is a cell in quotes open at the end of a line that is entered in the state ``entry``?

    A quote opens a cell only at its start, a doubled one inside stands for itself.
    """
    pieces = F.split(line, '"')

    def quote(state: Column, piece: Column) -> Column:
        opens = piece.endswith(",") | ((piece == "") & state.isin(_START, _CLOSED))
        return F.when(state == _INSIDE, _CLOSED).when(opens, _INSIDE).otherwise(_OUTSIDE)

    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(entry), quote) == _INSIDE


def _open_after(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """From what each row does to the state (``_from_out``, ``_from_in``: is a cell open after it?) what all rows up to it do.

    ``_set`` is the state that some row fixed whatever came before it (null: none did), ``_flip`` whether it is turned
    since; the state after the row is the fixed one, or else the entry's, turned so.
    """
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turned = rows.withColumn("_turns", F.sum(F.when(F.col("_from_out") & ~F.col("_from_in"), 1).otherwise(0)).over(upto))
    fixed = F.when(F.col("_from_out") == F.col("_from_in"), F.struct(F.col("_from_out").alias("open"), "_turns"))
    last = F.last(fixed, ignorenulls=True).over(upto)
    since = F.col("_turns") - F.coalesce(F.col("_last._turns"), F.lit(0))
    return turned.withColumn("_last", last).withColumns({"_set": F.col("_last.open"), "_flip": since % 2 == 1})


def file_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of text files, read in splits: ``_file``, ``_block`` (byte where the split starts), ``_row`` (rising in a split), ``value``."""
    lines = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(paths)
    place = {"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start")}
    return lines.select(*[c.alias(n) for n, c in place.items()], F.monotonically_increasing_id().alias("_row"), "value")


def file_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of delimited files whose cells in quotes may hold line breaks: ``_file``, ``_at``, ``record``.

    Large files are read by many tasks. Each split tells what its lines do to the state inside or outside quotes, for
    both states it may be entered in; a row per split carries state, bytes and the open record to the next ones. ``_at``
    is the number of bytes before the record, so it does not depend on the splits. Lines end with a line feed, before
    which a carriage return is dropped; a quote that is never closed makes the rest of its file one record, and that
    record must fit into a task. The lines are read once and landed, so that all steps see the same splits.
    """
    plain = ~F.col("value").contains('"')
    effect = {
        "_from_out": F.when(plain, False).otherwise(_still_open("value", _START)),
        "_from_in": F.when(plain, True).otherwise(_still_open("value", _INSIDE)),
    }
    split, size = ["_file", "_block"], F.octet_length("value").cast("long") + 1
    order = Window.partitionBy(*split).orderBy("_row")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    lines = _open_after(file_lines(spark, paths).withColumns(effect), split, "_row")
    lines = lines.withColumns({"_bytes": size, "_begin": F.sum(size).over(upto) - size})
    for entry in (False, True):  # the state before each line, and the start of its record, for either entry
        after = F.coalesce(F.col("_set"), F.lit(entry)) != F.col("_flip")
        lines = lines.withColumn(f"_open_{entry}", F.lag(after, 1, entry).over(order))
        lines = lines.withColumn(f"_record_{entry}", F.last(F.when(~F.col(f"_open_{entry}"), F.col("_begin")), ignorenulls=True).over(upto))
    text = F.regexp_replace("value", "\r$", "").alias("value")
    kept = [*split, "_row", "_begin", "_bytes", "_set", "_flip", "_open_False", "_open_True", "_record_False", "_record_True"]
    lines = landed(lines.select(*kept, text), "lines")

    end = F.max_by(F.struct("_set", "_flip"), "_row")
    splits = lines.groupBy(*split).agg(
        end.alias("_end"), F.sum("_bytes").alias("_bytes"),
        F.max("_record_False").alias("_record_False"), F.max("_record_True").alias("_record_True"),
    )
    for name, entry in (("_from_out", False), ("_from_in", True)):
        splits = splits.withColumn(name, F.coalesce("_end._set", F.lit(entry)) != F.col("_end._flip"))
    files = Window.partitionBy("_file").orderBy("_block")
    earlier = files.rowsBetween(Window.unboundedPreceding, -1)
    splits = _open_after(splits, ["_file"], "_block")
    after = F.coalesce(F.col("_set"), F.lit(False)) != F.col("_flip")
    splits = splits.withColumns({"_entry": F.lag(after, 1, False).over(files), "_base": F.coalesce(F.sum("_bytes").over(earlier), F.lit(0))})
    begun = F.col("_base") + F.when(F.col("_entry"), F.col("_record_True")).otherwise(F.col("_record_False"))
    splits = splits.withColumn("_begun", begun).withColumn("_left", F.last("_begun", ignorenulls=True).over(earlier))

    met = lines.join(splits.select(*split, "_entry", "_base", "_left"), split)
    local = F.when(F.col("_entry"), F.col("_record_True")).otherwise(F.col("_record_False"))
    begins = ~F.when(F.col("_entry"), F.col("_open_True")).otherwise(F.col("_open_False"))
    ends = F.coalesce("_set", "_entry") == F.col("_flip")
    placed = met.select(
        "_file", (F.col("_base") + F.col("_begin")).alias("_line"), F.coalesce(F.col("_base") + local, "_left").alias("_at"),
        "value", (begins & ends).alias("_whole"),
    )
    whole = placed.filter("_whole").select("_file", "_at", F.col("value").alias("record"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_line", "value"))), lambda x: x["value"])
    joined = placed.filter(~F.col("_whole")).groupBy("_file", "_at").agg(F.concat_ws("\n", parts).alias("record"))
    return whole.unionByName(joined)


def preamble_rows(
    spark: SparkSession, paths: str | list[str], columns: list[str], numeric: str, header: list[str] | None = None
) -> DataFrame:
    """All records of files whose header follows a block of notes, with ``kept``: is it a data record?

    Data are the records after the header of their file, which is the first record with the cells ``header`` (by
    default ``columns``, both compared as snake_case names), whose ``numeric`` cell is a number; what follows without
    one are notes. Records may be short (missing cells are null), hold quoted line breaks and grouped numbers; blank
    ones are none. A file without the header fails the job. Files are read in splits, see ``file_records``; the header's
    place is its byte in the file.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    records = file_records(spark, paths).filter(F.trim("record") != "")
    cells = F.from_csv("record", schema, {"quote": '"', "escape": '"'})
    rows = records.withColumn("_cells", cells).select("_file", "_at", *[F.col(f"_cells.`{c}`") for c in columns])
    plain = [F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9A-Za-z]+", "")) for c in columns]
    wanted = [re.sub(r"[^0-9A-Za-z]+", "", c).lower() for c in header or columns]
    is_header = F.lit(True)
    for cell, text in zip(plain, wanted):
        is_header = is_header & (cell == text)
    start = rows.groupBy("_file").agg(F.min(F.when(is_header, F.col("_at"))).alias("_start"))
    alarm = F.raise_error(F.concat(F.lit("no header found in "), "_file")).cast("bigint")
    joined = rows.join(start, "_file").withColumn("_start", F.coalesce("_start", alarm))
    kept = (F.col("_at") > F.col("_start")) & amount(numeric).isNotNull()
    return joined.select(*columns, F.coalesce(kept, F.lit(False)).alias("kept"))


def read_with_preamble(
    spark: SparkSession, paths: str | list[str], columns: list[str], numeric: str, header: list[str] | None = None
) -> DataFrame:
    """Data records of ``preamble_rows``, whose records with ``kept`` false tell what was left out."""
    return preamble_rows(spark, paths, columns, numeric, header).filter("kept").drop("kept")


def read_tagged(spark: SparkSession, paths: str | list[str], tags: dict[str, str]) -> DataFrame:
    """Files with columns taken from each file path (name -> pattern with one group); files meet by column name."""

    def pick(raw: DataFrame, names: list[str]) -> DataFrame:
        path = F.url_decode(F.col("_metadata.file_path"))
        made = [F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).alias(tag) for tag, pattern in tags.items()]
        return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(raw.columns, names)], *made)

    return _by_header(spark, paths, pick)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Landed text with the line number written at landing time: ``number<TAB>text``."""
    raw = spark.read.text(path)
    return raw.select(
        F.substring_index("value", "\t", 1).try_cast("bigint").alias("line"),
        F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1).alias("text"),
    )


def unfold_pairs(df: DataFrame, text: str, names: tuple[str, str]) -> DataFrame:
    """A line ``year,count,year,count...`` as one row per pair; cells may be quoted and hold thousands commas."""
    cells = F.transform(
        F.regexp_extract_all(text, F.lit(r'("[^"]*"|[^,]+)'), F.lit(1)),
        lambda x: F.replace(F.replace(x, F.lit('"')), F.lit(",")).try_cast("bigint"),
    )
    rows = df.select(cells.alias("_c"))
    ends = F.sequence(F.lit(0), F.floor(F.size("_c") / 2).cast("int") - 1)
    pairs = F.transform(ends, lambda i: F.struct(F.get("_c", i * 2).alias(names[0]), F.get("_c", i * 2 + 1).alias(names[1])))
    return rows.filter(F.size("_c") >= 2).select(F.inline(pairs))


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows with a declared schema, held in the plan itself (no Python task reads them)."""
    fields = DataType.fromDDL(schema).fields
    cells = {f"r{i}c{j}": cell for i, row in enumerate(rows) for j, cell in enumerate(row)}
    marks = [f"({', '.join(f':r{i}c{j}' for j in range(len(fields)))})" for i in range(len(rows))]
    names = ", ".join(f"`{f.name}`" for f in fields)
    raw = spark.sql(f"SELECT * FROM VALUES {', '.join(marks)} AS t({names})", args=cells)
    return raw.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])
