"""Row and column clean-up of landed tables."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from waymark.functions.text import fold_accents, snake_all
from waymark.operators.joins import lookup

# Labels of total and world-region rows in the monthly country sheets.
TOTAL_LABELS = [
    "Total", "Total general", "América", "América del Sur", "América del Norte", "Asia", "Europa",
    "Oceania", "África", "América Central", "Islas del Caribe",
]

# Sheet spellings of country names (exact label -> English name).
NAME_EXACT = {
    "Dominicana, Rep.": "Dominican Republic",
    "Corea, Rep. (Sur)": "South Korea",
    "Martinica (Terr. Ultram. Francia)": "Martinique",
    "Mianmar (Birmania)": "Burma",
    "Países Bajos (Holanda)": "Holland",
    "Brasil": "Brazil",
    "Camerun": "Cameroon",
    "Afganistan": "Afghanistan",
    "Rep. Dominicana": "Dominican Republic",
    "Republica Dominicana": "Dominican Republic",
}

# Sheet spellings recognised by a part of the label.
NAME_PARTS = {
    "Estados Unidos": "United States",
    "Irak": "Iraq",
    "Irán": "Iran",
    "Centroafricana, Rep.": "Central African Republic",
    "Checa, Rep.": "Czech Republic",
    "Fiyi": "Fiji",
    "Oceanía": "Other",
    "Perú": "Peru",
    "Micronesia, Rep.": "Other",
    "Apátridas": "Stateless",
    "China": "China",
}


def rename(df: DataFrame, names: dict[str, str], keep_only: bool = False) -> DataFrame:
    """Rename by name; with ``keep_only`` the result has just the renamed columns, in that order."""
    if keep_only:
        return df.select(*[F.col(old).alias(new) for old, new in names.items()])
    return df.withColumnsRenamed(names)


def rename_positions(df: DataFrame, names: list[str]) -> DataFrame:
    """Rename by position; columns beyond the given names are dropped."""
    return df.select(*df.columns[: len(names)]).toDF(*names)


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*snake_all(df.columns))


def drop_labels(df: DataFrame, column: str, labels=TOTAL_LABELS, containing: list[str] | None = None) -> DataFrame:
    """Drop total, region and other summary rows; rows with a null label stay."""
    out = F.coalesce(F.col(column).isin(list(labels)), F.lit(False))
    for part in containing or []:
        out = out | F.coalesce(F.col(column).contains(part), F.lit(False))
    return df.filter(~out)


def drop_footnote_rows(df: DataFrame, column: str, longest: int = 9) -> DataFrame:
    """Drop rows whose label is longer than a label can be.

    For a sheet whose notes are known only by their length; the sheet normalisers tell notes by their shape instead.
    """
    return df.filter(F.length(column) <= longest)


def recode(value, exact: dict[str, str] | None = None, patterns: dict[str, str] | None = None) -> Column:
    """New label by exact match, then by the first pattern found; other labels stay."""
    c = F.col(value) if isinstance(value, str) else value
    out = c
    if exact:
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(exact.items())])
        out = F.coalesce(F.try_element_at(table, c), c)
    if not patterns:
        return out
    branches = None
    for pattern, label in patterns.items():
        hit = c.rlike(pattern)
        branches = F.when(hit, label) if branches is None else branches.when(hit, label)
    return branches.otherwise(out)


def standardise_country(df: DataFrame, column: str, aliases: DataFrame, name: str = "citizenship") -> DataFrame:
    """Canonical country name by alias table (``alias``, ``canonical``); unknown names stay as they are.

    Both sides meet on the upper-case, accent-free, trimmed spelling.
    """
    key = F.upper(F.trim(fold_accents(column)))
    table = aliases.select(F.upper(F.trim(fold_accents("alias"))).alias("_key"), F.col("canonical").alias("_canon"))
    joined = lookup(df.withColumn("_key", key), table, ["_key"])
    return joined.withColumn(name, F.upper(F.coalesce("_canon", F.col(column)))).drop("_key", "_canon")


def numeric_columns(df: DataFrame, but: list[str] | None = None) -> list[str]:
    skip = set(but or [])
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in skip]


def null_to_zero(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nulls of the listed (or all numeric) columns become 0."""
    return df.fillna(0, subset=columns or numeric_columns(df))


def drop_nulls(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.dropna(subset=columns)


def drop_zero_columns(df: DataFrame, but: list[str] | None = None) -> DataFrame:
    """Drop numeric columns that sum to 0; one aggregate row with one cell per column decides.

    The names of the result depend on the data, so that row is computed when the plan is built: the frame's own work runs
    once then and once more when the result is read. Land an expensive frame first.
    """
    columns = numeric_columns(df, but)
    if not columns:
        return df
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if sums[c] == 0])


def split_fields(df: DataFrame, text: str, positions: dict[int, str], pattern: str = r"\s+") -> DataFrame:
    """Split a text line and keep chosen fields (1-based position -> name)."""
    cells = F.split(F.trim(text), pattern)
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, *[F.get(cells, F.lit(i - 1)).alias(name) for i, name in positions.items()])


def lines_between(
    df: DataFrame, text: str, line: str, start: str, end: str, by: list[str] | None = None
) -> DataFrame:
    """Lines from the first one that matches ``start`` to the next one that matches ``end``, both included.

    The two line numbers come from aggregates per file, so no file is sorted in one task.
    """
    by = list(by or [])
    on = F.lit(True)
    for k in by:
        on = on & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))

    def attach(rows, limits, cell):
        if by:
            return rows.alias("l").join(limits.alias("r"), on).select("l.*", f"r.{cell}")
        return rows.withColumn(cell, limits.scalar())

    first = df.filter(F.col(text).rlike(start)).groupBy(*by).agg(F.min(line).alias("_from"))
    tail = attach(df, first, "_from").filter(F.col(line) >= F.col("_from"))
    last = tail.filter(F.col(text).rlike(end)).groupBy(*by).agg(F.min(line).alias("_to"))
    return attach(tail, last, "_to").filter(F.col(line) <= F.col("_to")).drop("_from", "_to")


def shift_left(df: DataFrame, columns: list[str]) -> DataFrame:
    """Close up the cells of rows whose first value is missing; other rows stay."""
    cells = F.array(*columns)
    closed = F.filter(cells, lambda x: x.isNotNull())
    moved = [F.when(F.col(columns[0]).isNull(), F.get(closed, F.lit(i))).otherwise(F.col(c)).alias(c)
             for i, c in enumerate(columns)]
    at = dict(zip(columns, moved))
    return df.select(*[at.get(c, F.col(c)) for c in df.columns])


def block_label(position, labels: list[str], width: int, first: int) -> Column:
    """Label of a column by its position, for a sheet of equally wide blocks."""
    p = F.col(position) if isinstance(position, str) else position
    index = F.floor((p - first) / width).cast("int")
    return F.when((p >= first) & (index < len(labels)), F.get(F.array(*[F.lit(x) for x in labels]), index))


def range_label(position, ranges: list[tuple[int, int, str]]) -> Column:
    """Label of a column by its position, for blocks of uneven width."""
    p = F.col(position) if isinstance(position, str) else position
    out = F.lit(None).cast("string")
    for low, high, label in reversed(ranges):
        out = F.when(p.between(low, high), F.lit(label)).otherwise(out)
    return out


def part_month(value, date, when: str, factor: float = 0.5) -> Column:
    """Scale the one month that is only partly in scope."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col(date) == F.lit(when).cast("date"), v * factor).otherwise(v.cast("double"))
