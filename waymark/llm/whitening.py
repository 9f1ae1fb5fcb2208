"""Whitened principal components of embeddings from exact integer moments, by bit-sliced scatter.

Each entry becomes an integer. A block of rows is shifted by its least value per dimension, and every bit of the shifted
values becomes a plane: one bit per row, packed into 64-bit words. The cross-product of two dimensions is the sum, over
their pairs of planes, of the population count of the AND of both planes, times the weight of the two bits. Tasks add
these up as integers, one decimal sum per pair of dimensions brings the tasks together, and the driver centres the
d x d sums as integers before it takes the eigenvectors. No row leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.llm.common import landed

SCALE, OFFSET = 64, 1_000_000
#: Rows whose bit planes are held at once.
BLOCK = 8192
#: Values beyond this cannot be held as integers with room for sums of a block.
LARGEST = 1 << 48
#: Components whose variance is below this share of the largest have none but rounding.
NEGLIGIBLE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n rows, their sum per dimension, unit eigenvectors (columns) by falling eigenvalue, and the total variance."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def live(self) -> np.ndarray:
        """Components that have a variance."""
        return self.values > NEGLIGIBLE * max(self.trace, 0.0)

    @property
    def projection(self) -> np.ndarray:
        return self.vectors[:, self.live] / np.sqrt(self.values[self.live])


def usable(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrices of the vectors without null or non-finite entries, one length at a time."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    broken = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (sizes > 0) & (broken[starts + sizes] == broken[starts])
    for d in np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        for at in range(0, len(rows), limit):
            part = rows[at : at + limit]
            scaled = np.floor(SCALE * flat[starts[part][:, None] + np.arange(d)])
            if np.abs(scaled).max() > LARGEST:
                raise OverflowError(f"an entry lies beyond {LARGEST // SCALE}: its integer sums would not be exact")
            yield part, scaled.astype(np.int64) + OFFSET


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes of 64-bit words, one bit per row, with the dimension and the bit of each plane; empty planes are left out."""
    rows, d = shifted.shape
    owners, bits, planes = [], [], []
    words = -(-rows // 64)
    padded = np.zeros((d, words * 64), np.uint8)
    for bit in range(int(shifted.max(initial=0)).bit_length()):
        padded[:, :rows] = ((shifted >> bit) & 1).T
        packed = np.packbits(padded, axis=1).view(np.uint64)
        held = np.flatnonzero(packed.any(axis=1))
        owners.append(held)
        bits.append(np.full(len(held), bit))
        planes.append(packed[held])
    if not planes:
        return np.empty(0, int), np.empty(0, int), np.empty((0, words), np.uint64)
    return np.concatenate(owners), np.concatenate(bits), np.concatenate(planes)


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums per dimension and cross-products of all pairs of dimensions of an integer matrix (Python integers)."""
    rows, d = x.shape
    least = x.min(axis=0)
    owner, bit, planes = bit_planes(x - least)
    counts = np.zeros((len(owner), len(owner)), np.int64)
    for i in range(len(owner)):
        counts[i, i:] = np.bitwise_count(planes[i:] & planes[i]).sum(axis=1, dtype=np.int64)
    counts += np.triu(counts, 1).T
    # 64-bit sums where no weighted sum of the block can leave them, else Python integers
    kind = np.int64 if 2 * int(bit.max(initial=0) + 1) + rows.bit_length() < 63 else object
    sums, cross = np.zeros(d, kind), np.zeros((d, d), kind)
    for b in np.unique(bit).tolist():
        # planes of one bit have different owners, so each cell is met once
        mine = np.flatnonzero(bit == b)
        sums[owner[mine]] += counts[mine, mine].astype(kind) << b
        for c in np.unique(bit).tolist():
            other = np.flatnonzero(bit == c)
            cross[np.ix_(owner[mine], owner[other])] += counts[np.ix_(mine, other)].astype(kind) << (b + c)
    base, sums = least.astype(object), sums.astype(object)
    across = np.multiply.outer(base, sums)
    return sums + rows * base, cross.astype(object) + across + across.T + rows * np.multiply.outer(base, base)


def decimals(values, scale: int = 0) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, scale))


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = 32) -> Whitening:
    """Fit on all vectors of ``df`` in one pass over them, and measure the result in a second. Runs jobs at once.

    Vectors that are null or empty, or hold a null or non-finite entry, are left out. All others should have one length;
    where they don't, the most frequent length counts (of equally frequent ones the largest), and vectors of other
    lengths are left out too. An entry beyond 2^42 fails the job. Repeated rows count each. A table without vectors gives
    a model of no rows and no components. The driver holds d x d sums, whatever the number of rows.
    """

    def moments(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in usable(batch.column(0)):
                mine = held.setdefault(x.shape[1], [0, 0, 0])
                for i, part in enumerate((len(x), *scatter(x))):
                    mine[i] = mine[i] + part
        for d, (n, sums, cross) in held.items():
            j, k = np.triu_indices(d)
            # one cell for n, d for the sums, the upper triangle for the cross-products
            left = np.concatenate([[-1], np.full(d, -1), j])
            right = np.concatenate([[-1], np.arange(d), k])
            columns = [pa.array(np.full(len(left), d), pa.int32()), pa.array(left, pa.int32()), pa.array(right, pa.int32())]
            columns.append(decimals([n, *sums, *cross[j, k]]))
            yield pa.RecordBatch.from_arrays(columns, names=["d", "j", "k", "total"])

    parts = df.select(vector).mapInArrow(moments, "d int, j int, k int, total decimal(38,0)")
    cells = landed(parts.groupBy("d", "j", "k").agg(F.sum("total").alias("total")), "moments")
    frequent = cells.filter("j = -1 and k = -1").orderBy(F.desc("total"), F.desc("d")).first()
    if frequent is None:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0)
    d, n = frequent.d, int(frequent.total)
    sums, cross = np.zeros(d, object), np.zeros((d, d), object)
    for c in cells.filter(F.col("d") == d).collect():
        if c.j >= 0:
            cross[c.j, c.k] = cross[c.k, c.j] = int(c.total)
        elif c.k >= 0:
            sums[c.k] = int(c.total)
    centred = n * cross - np.multiply.outer(sums, sums)  # n^2 times the covariance, exact
    covariance = (centred / (n * n)).astype(np.float64)
    values, vectors = np.linalg.eigh(covariance)
    top = np.argsort(-values, kind="stable")[: min(components, d)]
    model = Whitening(n, tuple(sums), vectors[:, top], values[top], float(np.trace(covariance)))
    return replace(model, identity_error=measured_error(df, model, vector))


def whitened_blocks(column: pa.Array, model: Whitening):
    """Row numbers, squared deviations and whitened values of the vectors that have the model's length."""
    sums, projection = np.array(model.sums, object), model.projection
    bound = max((abs(s) for s in sums), default=0)
    for rows, x in usable(column):
        if x.shape[1] != len(sums):
            continue
        # 64-bit products where n * x and the sums fit, else Python integers
        wide = model.n * int(np.abs(x).max()) + bound >= 1 << 62
        deviation = x.astype(object) * model.n - sums if wide else x * model.n - sums.astype(np.int64)
        as_float = deviation.astype(np.float64)
        if wide or np.square(as_float).sum(axis=1).max() > 2.0**62:
            squares = (deviation.astype(object) ** 2).sum(axis=1)
            if max(squares) >= 1 << 63:
                raise OverflowError("the squared deviation of a vector does not fit into a long")
            squares = squares.astype(np.int64)
        else:
            squares = np.square(deviation).sum(axis=1)
        yield rows, squares, (as_float / model.n) @ projection


def measured_error(df: DataFrame, model: Whitening, vector: str) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity; null without live components."""
    live = int(model.live.sum())
    if not live:
        return None

    def products(batches):
        total = np.zeros((live, live))
        for batch in batches:
            for _, _, w in whitened_blocks(batch.column(0), model):
                total += w.T @ w
        j, k = np.triu_indices(live)
        # decimals, so that the order of tasks does not matter
        columns = [pa.array(j, pa.int32()), pa.array(k, pa.int32()), decimals([f"{v:.15f}" for v in total[j, k]], 15)]
        yield pa.RecordBatch.from_arrays(columns, names=["j", "k", "total"])

    cells = df.select(vector).mapInArrow(products, "j int, k int, total decimal(38,15)")
    cells = cells.groupBy("j", "k").agg(F.sum("total").alias("total")).collect()
    return max(abs(float(c.total) / model.n - (c.j == c.k)) for c in cells)


def whiten(df: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Replace the vector by ``deviation`` (sum over dimensions of (n x - S)^2) and ``whitened`` (one entry per component).

    Rows whose vector is null, broken or of another length than the model's go. A component without variance has a null
    entry. Columns of ``df`` that have one of the two names are replaced. A squared deviation beyond a long fails the job.
    """
    df = df.drop("deviation", "whitened")
    kept = [c for c in df.columns if c != vector]
    added = StructType.fromDDL("deviation bigint, whitened array<double>").fields
    full = StructType([*df.select(*kept).schema.fields, *added])
    live, width = model.live, len(model.values)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(full)
        for batch in batches:
            for rows, squares, w in whitened_blocks(batch.column(vector), model):
                entries = np.full((len(rows), width), np.nan)
                entries[:, live] = w
                flat = pa.array(entries.ravel(), mask=np.tile(~live, len(rows)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), flat)
                columns = [batch.column(c).take(pa.array(rows)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(squares), lists], schema=schema)

    return df.mapInArrow(run, full)


def component_rows(whitened: DataFrame, model: Whitening, key: str) -> DataFrame:
    """One row per vector and component, with the component's share of the variance (null where there is none at all)."""
    shares = [float(max(v, 0.0) / model.trace) if model.trace > 0 else None for v in model.values]
    error = F.lit(model.identity_error).cast("double")
    rows = whitened.select(key, "deviation", F.posexplode("whitened").alias("place", "value"))
    return rows.select(
        key,
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.col("value").alias("whitened"),
        F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("place")).alias("explained"),
        error.alias("identity_error"),
    )
