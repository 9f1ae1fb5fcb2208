"""Flow edge tables and flow lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.joins import lookup, on_keys
from waymark.operators.order import sharing
from waymark.operators.reshape import to_long, to_wide
from waymark.sources.delimited import inline_table

WHOLE = ("byte", "short", "integer", "long")


def edge_table(
    df: DataFrame, stages: list[str], value: str, extra: list[str] | None = None, least: float | None = None
) -> DataFrame:
    """Two rows (``from`` and ``to``) per pair of neighbouring stages, with the total that flows into each node.

    Rows are summed over the stage columns first; edges below ``least`` are dropped after the node totals.
    """
    extra = list(extra or [])
    paths = df.groupBy(*stages, *[e for e in extra if e not in stages]).agg(F.sum(value).alias(value))
    edge = F.concat_ws(">", *[F.coalesce(s, F.lit("")) for s in stages])
    ends = []
    for i in range(len(stages) - 1):
        for connector, j in (("from", i), ("to", i + 1)):
            ends.append(
                F.struct(
                    F.concat(edge, F.lit(f"#{i + 1}")).alias("edge_id"),
                    F.lit(connector).alias("connector"),
                    F.lit(stages[j]).alias("stage"),
                    F.col(stages[j]).alias("node"),
                )
            )
    keep = [F.col(e).alias(f"by_{e}") if e in stages else F.col(e) for e in extra]
    long = paths.select(*keep, value, F.inline(F.array(*ends)))
    into = long.groupBy("node").agg(F.sum(F.when(F.col("connector") == "to", F.col(value))).alias("node_total"))
    out = long.alias("l").join(into.alias("r"), on_keys(["node"], null_safe=True)).select(
        "l.*", F.coalesce("r.node_total", F.lit(0)).alias("node_total")
    )
    return out if least is None else out.filter(F.col(value) >= least)


def staged_split(
    df: DataFrame,
    hosts: list[str],
    regular: DataFrame,
    value: str,
    start: str = "LAC",
    other: str = "OTHER",
    after: str = "transparent",
) -> DataFrame:
    """Hosts leave the common stream one stage after another.

    Every host's total splits into its regular count (``host``, ``regular``) and the irregular remainder. A host
    stands in ``other`` until its own stage and in ``after`` behind it. Edges are summed per stage and node pair.
    """
    label = F.when(F.col("coa_iso").isin(hosts), F.col("coa_iso")).otherwise(other)
    totals = df.groupBy(label.alias("host")).agg(F.sum(value).alias(value))
    joined = lookup(totals, regular, ["host"])
    known = F.coalesce("regular", F.lit(0))
    kinds = F.array(
        F.struct(F.lit("regular").alias("kind"), known.alias("amount")),
        F.struct(F.lit("irregular").alias("kind"), (F.col(value) - known).alias("amount")),
    )
    parts = joined.select("host", F.inline(kinds))
    turn = F.array_position(F.array(*[F.lit(h) for h in hosts]), F.col("host")).cast("int")
    turn = F.when(turn > 0, turn).otherwise(len(hosts) + 1)
    last = len(hosts) + 1

    def node(stage):
        waiting = F.when(stage <= turn, other).when(stage == turn + 1, F.col("host")).otherwise(after)
        return F.when(stage == 1, start).when(F.col("host") == other, other).otherwise(waiting)

    steps = F.transform(
        F.sequence(F.lit(1), F.lit(last - 1)),
        lambda s: F.struct(s.alias("stage"), node(s).alias("node_from"), node(s + 1).alias("node_to")),
    )
    edges = parts.filter(F.col("amount") > 0).select("kind", "amount", F.inline(steps))
    return edges.groupBy("stage", "node_from", "node_to", "kind").agg(F.sum("amount").alias(value))


def centroids(vertices: DataFrame, key: str, position: str = "pos") -> DataFrame:
    """Area centroid of each polygon from its vertices (``pos`` 1..n, ``x``, ``y``), by the shoelace sums.

    Vertices stay rows: each meets its successor through a join on the position, so a long outline is spread over
    tasks like any other rows. The sums grow with the third power of the coordinates: those of whole numbers are exact
    to 38 digits, beyond which the job fails.
    """
    whole = all(vertices.schema[c].dataType.typeName() in WHOLE for c in ("x", "y"))
    if whole:
        vertices = vertices.withColumns({c: F.col(c).cast("decimal(20,0)") for c in ("x", "y")})
    sizes = vertices.groupBy(key).agg(F.count(sharing(sharing(position, "x"), "y")).alias("_n"))
    rows = vertices.alias("l").join(sizes.alias("r"), on_keys([key])).select("l.*", "r._n")
    rows = rows.withColumn("_next", F.when(F.col(position) == F.col("_n"), 1).otherwise(F.col(position) + 1))
    step = vertices.select(
        F.col(key).alias("_key"), F.col(position).alias("_pos"), F.col("x").alias("_x2"), F.col("y").alias("_y2")
    )
    edges = rows.join(step, (F.col(key) == F.col("_key")) & (F.col("_next") == F.col("_pos")))
    cross = F.col("x") * F.col("_y2") - F.col("_x2") * F.col("y")
    sums = edges.groupBy(key).agg(
        F.sum(cross).alias("_a"),
        F.sum((F.col("x") + F.col("_x2")) * cross).alias("_cx"),
        F.sum((F.col("y") + F.col("_y2")) * cross).alias("_cy"),
    )
    kept = (lambda c: c.cast("double")) if whole else (lambda c: c)
    area = kept(F.col("_a") * 3)
    return sums.select(
        key,
        F.try_divide(kept(F.col("_cx")), area).alias("x"),
        F.try_divide(kept(F.col("_cy")), area).alias("y"),
    )


# End point and display name of each location on the map.
DESTINATIONS = [
    ("darien", -77.0, 7.0, "Darien Gap"),
    ("southwest", -98.0, 39.0, "US Southwest Border"),
    ("mexico", -102.5, 23.5, "Mexico Border"),
]


def flow_lines(origins: DataFrame, counts: DataFrame, key: str, destinations=DESTINATIONS) -> DataFrame:
    """One line per origin and location: centroid, end point, count, and whether there is anything to draw."""
    codes = [d[0] for d in destinations]
    wide = to_wide(counts, [key], "location", codes, "encounter_count")
    joined = lookup(origins, wide, [key])
    long = to_long(joined, [key, "x", "y"], codes, "code", "ac")
    ends = inline_table(
        counts.sparkSession,
        [(code, x, y, name) for code, x, y, name in destinations],
        "code string, xend double, yend double, location string",
    )
    placed = lookup(long, ends, ["code"]).drop("code")
    return placed.withColumn("alpha", F.when(F.col("ac").isNull(), 0).otherwise(1))
