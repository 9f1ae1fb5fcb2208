"""Running totals, positions, fill-down and exact medians without a single-task window.

A window without a partition, or one over a single huge group, sorts everything in one task. The operators here
work in two levels instead. Rows fall into blocks by a rule that keeps their order; the window runs inside a
block, and a small table with one row per block carries the sums of the earlier blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.session import landed

BLOCK_LINES = 100_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sharing(column, other) -> Column:
    """The column itself, written so that ``other`` stays in the plan.

    Two readers of one aggregated frame share its shuffle only when both need the same columns: column pruning would
    otherwise give each its own scan of the facts.
    """
    c = _col(column)
    return F.coalesce(F.when(_col(other).isNotNull(), c), c)


def magnitude_block(value, per_doubling: int = 16) -> Column:
    """Block number that never falls as ``value`` rises, from about 1e-6 up; infinities and NaN have end blocks.

    All rows of one value share a block. A window inside a block suits a frame with few rows per value, such as
    distinct levels or group totals.
    """
    v = _col(value).cast("double")
    end = F.lit(2**30)
    inside = (F.signum(v) * F.floor(F.log2(F.abs(v) * 2.0**20 + 1) * per_doubling)).try_cast("int")
    ends = F.when(F.isnan(v), end + 1).when(v == float("inf"), end).when(v == float("-inf"), -end)
    return ends.otherwise(inside)


def line_block(line, size: int = BLOCK_LINES) -> Column:
    """Block number of a line number."""
    return F.floor(_col(line) / size).cast("long")


def _on(keys: list[str], left: str, right: str, plain: tuple[str, ...] = ()) -> Column:
    """Null-safe equality of the keys, and plain equality of key columns that are never null.

    A join on plain keys keeps the partitioning of a window on the same keys, so it needs no further shuffle.
    """
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    for k in plain:
        on = on & (F.col(f"{left}.{k}") == F.col(f"{right}.{k}"))
    return on


def running_total(
    df: DataFrame,
    value,
    order: list,
    block: Column,
    name: str,
    by: list[str] | None = None,
) -> DataFrame:
    """Running sum of ``value`` in the order of ``order``, per ``by`` or over the whole frame.

    ``block`` must follow the order: every row of a lower block comes before every row of a higher one
    (``F.year("date")`` for a date order, ``magnitude_block`` for a numeric order). Rows without a block come first,
    as nulls do in an ascending order.
    """
    by = list(by or [])
    keys = [*by, "_block"]
    rows = df.withColumn("_v", _col(value)).withColumn("_block", F.coalesce(block.cast("long"), F.lit(-(2**62))))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*keys)
        .agg(F.sum("_v").alias("_sum"))
        .select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    )
    local = rows.withColumn("_local", F.sum("_v").over(inside))
    joined = local.alias("l").join(carry.alias("c"), _on(by, "l", "c", ("_block",)))
    return joined.select(
        *[F.col(f"l.{c}") for c in df.columns], (F.col("l._local") + F.col("c._carry")).alias(name)
    )


def running_total_split(
    df: DataFrame, value, order: list, name: str, by: list[str] | None = None, parts: int | None = None
) -> DataFrame:
    """``running_total`` for any order: the blocks are cut by Spark's range partitioning, also inside one value.

    The rows are landed with a number first. It comes last in the order, so rows that are equal in ``order`` can lie in
    several blocks, however many there are, and a block holds about a ``parts``-th of the rows (by default as many as
    shuffle partitions). Equal rows follow each other in any order. Runs jobs at once.
    """
    by = list(by or [])
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken = {"_tie": F.monotonically_increasing_id(), "_v": _col(value)}
    rows = landed(df.withColumns(taken), "rows")
    cut = rows.repartitionByRange(parts, *by, *order, "_tie").withColumn("_block", F.spark_partition_id())
    cut = landed(cut, "blocks")
    total = running_total(cut, "_v", [*order, "_tie"], F.col("_block"), name, by)
    return total.select(*[F.col(f"`{c}`") for c in df.columns], name)


def ordinal(df: DataFrame, order: list, block: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Row position 1, 2, 3 ... in an explicit order; ``block`` as in ``running_total``."""
    return running_total(df, F.lit(1).cast("long"), order, block, name, by)


def dense_position(df: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """Dense rank of ``value`` over the whole frame: 1 for the lowest (or highest) distinct value."""
    key = -F.col(value) if descending else F.col(value)
    levels = df.select(key.alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    placed = ordinal(levels, [F.col("_key")], magnitude_block("_key"), name)
    joined = df.withColumn("_key", key).join(placed, "_key", "left")
    return joined.select(*df.columns, F.col(name).cast("int").alias(name))


def fill_down(
    df: DataFrame, columns: list[str], line: str, by: list[str] | None = None, size: int = BLOCK_LINES
) -> DataFrame:
    """Replace nulls by the nearest earlier non-null value in line order.

    ``by`` names the file or sheet; a file of any length is split into blocks of ``size`` lines. A line without a number
    keeps what it has.
    """
    by = list(by or [])
    # lines without a number form a block of their own before the others; file names are keys that are never null, so
    # that windows and join share one shuffle
    named = {f"_by{i}": F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for i, c in enumerate(by)}
    rows = df.withColumns({**named, "_block": F.coalesce(line_block(line, size), F.lit(-(2**62)))})
    keys = [*named, "_block"]
    inside = Window.partitionBy(*keys).orderBy(line).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*named).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    known = F.col("_block") > F.lit(-(2**62))  # nothing is carried from lines of unknown place
    ends = rows.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull() & known, F.col(line))).alias(f"_end_{c}") for c in columns]
    )
    carry = ends.select(
        *keys, *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns]
    )
    filled = rows
    for c in columns:
        filled = filled.withColumn(f"_fill_{c}", F.when(known, F.last(c, ignorenulls=True).over(inside)).otherwise(F.col(c)))
    joined = filled.join(carry, keys)
    return joined.select(
        *[F.coalesce(f"_fill_{c}", f"_carry_{c}").alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def nearest(
    df: DataFrame,
    line: str,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    strictly: dict[str, Column] | None = None,
    by: list[str] | None = None,
    size: int = BLOCK_LINES,
) -> DataFrame:
    """Add the nearest non-null value of expressions in line order: at the row or earlier (``before``), at the row or
    later (``after``), or earlier than the row (``strictly``).

    Works in blocks like ``fill_down``: one window inside blocks of ``size`` lines, and a row per block that carries. Every
    row needs a line number, and the columns ``by`` values that are never null.
    """
    by, before, after, strictly = list(by or []), before or {}, after or {}, strictly or {}
    every = {**before, **after, **strictly}
    rows = df.withColumns({"_block": line_block(line, size), **{f"_e_{c}": e for c, e in every.items()}})
    keys = [*by, "_block"]
    inside, blocks = Window.partitionBy(*keys).orderBy(line), Window.partitionBy(*by).orderBy("_block")
    first, last = Window.unboundedPreceding, Window.unboundedFollowing
    place = {c: F.when(F.col(f"_e_{c}").isNotNull(), F.col(line)) for c in every}
    ends = rows.groupBy(*keys).agg(
        *[(F.min_by if c in after else F.max_by)(f"_e_{c}", place[c]).alias(f"_c_{c}") for c in every]
    )

    def reach(c: str, prefix: str, window, own: bool) -> Column:
        if c in after:
            return F.first(prefix + c, ignorenulls=True).over(window.rowsBetween(0 if own else 1, last))
        return F.last(prefix + c, ignorenulls=True).over(window.rowsBetween(first, 0 if own else -1))

    carry = ends.select(*keys, *[reach(c, "_c_", blocks, False).alias(f"_c_{c}") for c in every])
    joined = rows.withColumns({f"_h_{c}": reach(c, "_e_", inside, c not in strictly) for c in every}).join(carry, keys)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(f"_h_{c}", f"_c_{c}").alias(c) for c in every])


#: Distinct values that one window of the median may sort, and the cells that a wider stretch of values is cut into.
MEDIAN_VALUES, MEDIAN_CELLS = 100_000, 4_096


def _middle_ranks() -> tuple[Column, Column]:
    return F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)


def _middle_cells(counted: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Of counted cells (``_n`` rows, ``_carry`` rows before the first, ``_all`` in the group) those with a middle rank."""
    upto = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("_upto", F.col("_carry") + F.sum("_n").over(upto))
    low, high = _middle_ranks()
    start = F.col("_upto") - F.col("_n")
    return placed.filter((low <= F.col("_upto")) & (high > start)).select(*keys, cell, start.alias("_carry"), "_all")


def _median_of_cells(values: DataFrame, keys: list[str], firsts: list[Column], value: str, name: str) -> DataFrame:
    """Median per group from the distinct values (``_n`` rows each) of the blocks that hold a middle rank.

    While a block holds more distinct values than one window should sort, it is cut into equal cells, of which only those
    with a middle rank are kept.
    """
    held = [*keys, "_block", "_carry", "_all"]
    while True:
        cells = values.groupBy(*held).agg(F.count(F.lit(1)).alias("_values"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        if cells.filter(F.col("_values") > MEDIAN_VALUES).isEmpty():
            break
        step = (F.col("_high").cast("double") - F.col("_low")) / MEDIAN_CELLS
        place = F.least(F.floor((F.col(value) - F.col("_low")) / step), F.lit(MEDIAN_CELLS - 1))
        cell = F.when(F.col("_values") > MEDIAN_VALUES, place).otherwise(0)
        cut = values.join(cells.drop("_carry", "_all"), [*keys, "_block"]).withColumn("_cell", cell)
        sized = cut.groupBy(*held, "_cell").agg(F.sum("_n").alias("_n"))
        middle = _middle_cells(sized, [*keys, "_block"], "_cell").select(*keys, "_block", "_cell", F.col("_carry").alias("_from"))
        kept = cut.join(middle, [*keys, "_block", "_cell"])
        # a kept cell is the next block; the rows before it number it, in order and once per group
        blocks = {"_block": F.col("_from"), "_carry": F.col("_from")}
        values = landed(kept.withColumns(blocks).select(*values.columns), "values")
    upto = Window.partitionBy(*keys, "_block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("_upto", F.col("_carry") + F.sum("_n").over(upto))
    low, high = _middle_ranks()

    def at(position):
        return (position > F.col("_upto") - F.col("_n")) & (position <= F.col("_upto"))

    middle_two = F.max(F.when(at(low), F.col(value))) + F.max(F.when(at(high), F.col(value)))
    return ranked.groupBy(*keys).agg(*firsts, (middle_two / F.lit(2.0)).alias(name)).drop(*keys)


def exact_median(
    df: DataFrame, value: str, by: list[str] | None = None, name: str = "median", total: str | None = None
) -> DataFrame:
    """Exact median per group (or overall), and with ``total`` also over all groups, labelled so in the first column.

    A first pass counts rows per block of values (a few thousand counters per group). They tell which blocks hold the
    middle ranks, at most two per group; a second pass counts the values of those blocks, which rows meet on group and
    block (the total's one or two blocks are conditions of the same pass), and only these values are ranked. A block with
    very many values is cut again. Runs jobs at once; counts and values lie in the shared folder.
    """
    by = list(by or [])
    keys = [f"_k{i}" for i in range(len(by))]
    # names that are never null, so that equal keys are plain equalities
    named = {k: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c, k in zip(by, keys)}
    firsts = [F.first(c).alias(c) for c in by]
    rows = df.filter(F.col(value).isNotNull()).select(*by, value, magnitude_block(value, 256).alias("_block")).withColumns(named)
    counts = landed(rows.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n")), "counts")

    def middle(counted: DataFrame, of: list[str]) -> DataFrame:
        whole = F.sum("_n").over(Window.partitionBy(*of))
        return _middle_cells(counted.withColumns({"_carry": F.lit(0).cast("long"), "_all": whole}), of, "_block")

    over = []
    if total is not None and by:
        over = middle(counts.groupBy("_block").agg(F.sum("_n").alias("_n")), []).collect()  # two rows at most
    met = rows.join(landed(middle(counts, keys), "middle"), [*keys, "_block"], "left" if over else "inner")
    if over:
        met = met.filter(F.col("_all").isNotNull() | F.col("_block").isin([r["_block"] for r in over]))
    counted = met.groupBy(*keys, "_block", "_carry", "_all", value).agg(F.count(F.lit(1)).alias("_n"), *firsts)
    values = landed(counted, "values")
    out = _median_of_cells(values.filter("_all is not null"), keys, firsts, value, name)
    if not over:
        return out
    place = F.create_map(*[F.lit(x).cast("long") for r in over for x in (r["_block"], r["_carry"])])
    of_all = values.filter(F.col("_block").isin([r["_block"] for r in over])).groupBy("_block", value).agg(F.sum("_n").alias("_n"))
    of_all = of_all.withColumns({"_carry": place[F.col("_block").cast("long")], "_all": F.lit(over[0]["_all"])})
    whole = _median_of_cells(of_all, [], [], value, name).select(F.lit(total).alias(by[0]), name)
    return out.unionByName(whole, allowMissingColumns=True)


def top_with_ties(df: DataFrame, value: str, n: int, name: str = "rank") -> DataFrame:
    """Rows whose ``value`` ranks in the top ``n``, ties kept.

    The ``n`` largest rows come from a distributed top-k. They fix the at most ``n`` distinct values that qualify
    and their ranks, so the window sorts ``n`` rows whatever the size of the frame; every tied row comes back
    through the join on the value.
    """
    best = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("_top")).orderBy(F.desc("_top")).limit(n)
    ranks = best.select("_top", F.rank().over(Window.orderBy(F.desc("_top"))).alias(name)).distinct()
    return df.join(F.broadcast(ranks), F.col(value) == F.col("_top")).drop("_top")


def first_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """First ``n`` rows of an explicit order."""
    return df.orderBy(*order).limit(n)


def latest_per_group(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` columns in each group, found by a partial maximum (no sort)."""
    rest = [c for c in df.columns if c not in by and c not in order]
    packed = F.max(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*by).agg(packed).select(*by, *[F.col(f"_row.{c}").alias(c) for c in (*order, *rest)])


def at_latest(df: DataFrame, date: str = "date") -> DataFrame:
    """Rows at the latest date of the frame."""
    return df.filter(F.col(date) == df.agg(F.max(date)).scalar())


def by_order(column, order: list[str]) -> Column:
    """Position of a label in an explicit order; labels outside it come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), _col(column)).cast("int")
    return F.when(place > 0, place).otherwise(len(order) + 1)


def ranked_labels(df: DataFrame, label: str, value: str, name: str, descending: bool = True) -> DataFrame:
    """Order labels by the total of ``value``: attaches the dense position of each label's total."""
    totals = df.groupBy(label).agg(F.sum(value).alias("_total"))
    placed = dense_position(totals, "_total", name, descending).drop("_total")
    joined = df.alias("l").join(placed.alias("r"), _on([label], "l", "r"), "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.col(f"r.{name}"))
