"""Shared pieces of the text operators: reading, cutting lineage, Arrow batches, positions inside hot groups."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters that count as white space in every contract of this folder.
SPACE = "\\x20\\x09-\\x0D"
#: Texts of one Python step are handled in slices of about so many bytes.
SLICE_BYTES = 4 << 20
SUB_BLOCKS = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Only a local master (tests) may leave that unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="waymark-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/waymark-llm/{label}-{uuid.uuid4().hex}"


def landed(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage is cut and later reads prune columns."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # a frame without rows may leave no file, so the schema is given
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffled_joins(spark: SparkSession):
    """Joins planned inside never broadcast, so that a job has one plan at every size of its tables."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """Land a frame in buckets by ``key``, sorted inside, so that later joins on the key don't move it again.

    There are as many buckets as shuffle partitions. The files lie in the shared folder; the session's catalog gets a
    table of a new name, which says how they are cut.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"waymark_{uuid.uuid4().hex}"
    # each task holds whole buckets, so there is one file a bucket
    writer = df.repartition(n, key).write.bucketBy(n, key).sortBy(key)
    writer.option("path", shared_folder(spark, "buckets")).saveAsTable(name)
    return spark.table(name)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges of at most about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if i > start and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_texts(
    df: DataFrame, fn: Callable[[list[str]], dict[str, list]], schema: str, text: str = "text", keep_text: bool = False
) -> DataFrame:
    """Columns computed from the text, in Arrow batches, after those of ``df``; a null text counts as empty.

    The text itself goes unless ``keep_text`` is set.

    ``fn`` gets the texts of one slice and returns the columns that ``schema`` declares. It may be a factory: a
    function with attribute ``per_task`` set is called once per task and returns the slice function.
    """
    kept = [c for c in df.columns if keep_text or c != text]
    out = df.select(*kept).schema
    added = StructType.fromDDL(schema)
    full = StructType([*out.fields, *added.fields])
    names = added.names

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(full)
        work = fn() if getattr(fn, "per_task", False) else fn
        for part in slices(batches, text):
            made = work([t or "" for t in part.column(text).to_pylist()])
            columns = [part.column(c) for c in kept] + [pa.array(made[n], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, full)


def per_task(factory):
    factory.per_task = True
    return factory


def word_count(text: str) -> Column:
    """Number of runs without white space; null gives 0."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]+"))
    return words.cast("long")


def seeded(column: str, seed: int) -> Column:
    """MD5 of the seed and a value, by which ``placed`` orders; null is a value of its own."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))).cast("binary"))


def placed(
    df: DataFrame, group: list[str], order: list[str], value: Column, name: str, seed: int, blocks: int = SUB_BLOCKS
) -> DataFrame:
    """Sum of ``value`` over the rows of the same group that stand before a row, in a seeded order.

    The order is that of the MD5 of the seed and the first ``order`` column, then of all ``order`` columns. A group may
    hold any share of the rows: the first hex digits of the hash split it into ``blocks`` (a power of 16) parts, the
    window runs inside a part, and the sums of the parts (``blocks`` rows per group) carry over.
    """
    digits = len(f"{blocks:x}") - 1
    key = seeded(order[0], seed)
    # one key that is never null, so that window and join share a shuffle
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in group]
    rows = df.withColumns({"_key": key, "_value": value, "_group": F.concat_ws("\x00", *named)})
    rows = rows.withColumn("_part", F.substring("_key", 1, digits))
    both = ["_group", "_part"]
    inside = Window.partitionBy(*both).orderBy("_key", *order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*both).agg(F.sum("_value").alias("_sum"))
    carry = sums.select(*both, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    local = rows.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return local.join(carry, both).select(*df.columns, (F.col("_local") + F.col("_carry")).alias(name))
