"""Snapshot sink and the ledger that decides which dataset to refresh."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.operators.joins import full_join, on_keys
from waymark.sources.delimited import inline_table


def write_table(df: DataFrame, path: str, date: str | None = None, fmt: str = "parquet") -> None:
    """Overwrite a snapshot, partitioned by year of ``date`` so that later reads prune.

    Rows are clustered by month before the write: each month goes to few files, and adaptive execution splits a
    month that is too large for one task.
    """
    out = df
    if date is not None:
        out = df.withColumn("snapshot_year", F.year(date)).hint("rebalance", F.col("snapshot_year"), F.col(date))
    writer = out.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if date is not None:
        writer = writer.partitionBy("snapshot_year")
    writer.save(path)


def latest_dates(frames: dict[str, DataFrame], date: str = "date") -> DataFrame:
    """One row per dataset with its last date."""
    out = None
    for name, frame in frames.items():
        row = frame.agg(F.max(date).alias("latest_date")).select(F.lit(name).alias("dataset"), "latest_date")
        out = row if out is None else out.unionByName(row)
    return out


def refresh_gate(ledger: DataFrame, candidates: DataFrame) -> DataFrame:
    """Which candidates (``dataset``, ``new_date``) need a refresh: not in the ledger, undated, or newer."""
    joined = candidates.alias("l").join(ledger.alias("r"), on_keys(["dataset"]), "left")
    newer = F.col("r.latest_date").isNull() | (F.col("l.new_date") > F.col("r.latest_date"))
    return joined.select("l.dataset", "l.new_date", "r.latest_date", newer.alias("refresh"))


def ledger_update(ledger: DataFrame, refreshed: DataFrame, newer_only: bool = False) -> DataFrame:
    """Ledger with the last date of every refreshed dataset; with ``newer_only`` an older date doesn't replace a newer."""
    new = refreshed.groupBy("dataset").agg(F.max("latest_date").alias("_new"))
    both = full_join(ledger, new, ["dataset"])
    latest = F.greatest("_new", "latest_date") if newer_only else F.coalesce("_new", "latest_date")
    return both.select("dataset", latest.alias("latest_date"))


def as_of_date(ledger: DataFrame) -> DataFrame:
    """The date all datasets have reached."""
    return ledger.agg(F.min("latest_date").alias("date"))


def latest_good_snapshot(live: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of the newest snapshot per dataset.

    ``live`` holds the rows of the refreshes that worked; a dataset whose refresh failed or was skipped has none, so
    its newest stored snapshot is used. Both frames carry ``dataset`` and ``snapshot_date``. Where these partition
    landed snapshots, the newest dates come from one row per snapshot (at most a date per refresh), and the scan
    prunes to them.
    """
    both = stored.unionByName(live.select(*stored.columns))
    newest = both.groupBy("dataset").agg(F.max("snapshot_date").alias("snapshot_date"))
    chosen = newest.agg(F.collect_list(F.struct("dataset", "snapshot_date"))).scalar()
    return both.filter(F.array_contains(chosen, F.struct("dataset", "snapshot_date")))


#: Folder of the manifests beside the data, one file per commit; names with an underscore are no data to Spark.
MANIFESTS, LEDGER = "_manifests", "_ledger"
MANIFEST_FIELDS = "dataset string, snapshot_date date, folder string, files bigint, rows bigint, checksum bigint"
LEDGER_FIELDS = "version bigint, dataset string, latest_date date"


class Conflict(RuntimeError):
    """Another writer has taken the next version of the ledger."""


def _filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path: the shared folder may be in any store that Spark reaches."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def folder_exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop = _filesystem(spark, path)
    return fs.exists(hadoop)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove one folder of a stored table; none is fine."""
    fs, hadoop = _filesystem(spark, path)
    fs.delete(hadoop, True)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that must not exist yet; false where it does. The name appears only with all its text."""
    fs, target = _filesystem(spark, path)
    whole = spark._jvm.org.apache.hadoop.fs.Path(f"{target.getParent().toString()}/.{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    out = fs.create(whole, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(context.makeQualified(whole), context.makeQualified(target), options)
    except Exception as err:
        if "AlreadyExists" not in str(err):
            raise
        fs.delete(whole, False)
        return False
    return True


def _checked(rows: DataFrame) -> DataFrame:
    """Files, rows and an order-free checksum per snapshot folder, from the rows as read."""
    data = [c for c in rows.columns if c not in ("dataset", "snapshot_date", "_folder", "_file")]
    mixed = F.xxhash64(F.to_json(F.struct(*sorted(data)))) if data else F.lit(0)
    return rows.groupBy("dataset", "snapshot_date").agg(
        F.count_distinct("_file").alias("files"),
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor(mixed).alias("checksum"),
    )


def commit_snapshot(df: DataFrame, path: str, dataset: str, day: str) -> None:
    """Land one snapshot of a dataset in a folder of its own and commit it by a manifest that is written last.

    The manifest names the folder, its files, rows and a checksum, counted from what was read back. Rows of a snapshot
    without manifest (the job was interrupted) are never read; the same day may be landed again, and its last manifest
    counts. An empty snapshot is committed too, with no rows.
    """
    spark = df.sparkSession
    folder = f"{dataset}-{day}-{uuid.uuid4().hex}"
    df.drop("dataset", "snapshot_date").write.parquet(f"{path}/{folder}")
    # the files of this one folder are counted as they lie, also where they hold no rows
    back = spark.read.schema(df.drop("dataset", "snapshot_date").schema).parquet(f"{path}/{folder}")
    tagged = back.withColumns({"dataset": F.lit(dataset), "snapshot_date": F.lit(day).cast("date"), "_file": F.col("_metadata.file_path")})
    found = _checked(tagged).first()
    files, rows, checksum = (found.files, found.rows, found.checksum) if found else (0, 0, 0)
    line = {"dataset": dataset, "snapshot_date": day, "folder": folder, "files": files, "rows": rows, "checksum": checksum}
    order = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    if not _create(spark, f"{path}/{MANIFESTS}/{order}.json", json.dumps(line)):
        raise Conflict(f"manifest {order} exists")


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """The last manifest per dataset and day under a folder; a file that is no manifest is passed over."""
    raw = spark.read.schema(MANIFEST_FIELDS).option("mode", "DROPMALFORMED").json(f"{path}/{MANIFESTS}")
    named = raw.select("*", F.col("_metadata.file_name").alias("_order")).filter("folder is not null and snapshot_date is not null")
    last = named.groupBy("dataset", "snapshot_date").agg(F.max_by(F.struct("folder", "files", "rows", "checksum"), "_order").alias("m"))
    return last.select("dataset", "snapshot_date", "m.*")


def newest_committed(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Rows of the newest committed snapshot per dataset; with ``verify`` only of those that are still what was committed.

    ``verify`` reads the candidates and compares files, rows and checksum with the manifest; where they differ (a file is
    missing or was replaced), the next older committed snapshot counts. Snapshots of a dataset may differ in columns:
    they meet by name. The driver holds one line per snapshot. Fails where no dataset has a good snapshot.
    """
    lines = sorted(manifests(spark, path).collect(), key=lambda m: (m.dataset, m.snapshot_date), reverse=True)
    good, settled = [], set()
    while lines:
        # the newest of each dataset that has none yet, all checked in one job
        heads = {m.dataset: m for m in reversed(lines) if m.dataset not in settled}
        if not heads:
            break
        sound = _sound(spark, path, list(heads.values())) if verify else set(heads)
        good += [m for d, m in heads.items() if d in sound]
        settled |= sound
        lines = [m for m in lines if m.dataset not in settled and m is not heads[m.dataset]]
    if not good:
        raise ValueError(f"no committed snapshot under {path}")
    out = None
    for m in good:
        part = _folder_rows(spark, path, m).drop("_file")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _folder_rows(spark: SparkSession, path: str, line) -> DataFrame:
    rows = spark.read.parquet(f"{path}/{line.folder}")
    return rows.select(
        F.lit(line.dataset).alias("dataset"), F.lit(line.snapshot_date).alias("snapshot_date"), *[F.col(f"`{c}`") for c in rows.columns],
        F.col("_metadata.file_path").alias("_file"),
    )


def _sound(spark: SparkSession, path: str, lines: list) -> set[str]:
    """Datasets whose snapshot still has the files, rows and checksum of its manifest."""
    sound, out = {m.dataset for m in lines if m.rows == 0}, None
    for m in lines:
        if m.rows:
            try:
                part = _checked(_folder_rows(spark, path, m))
            except Exception as err:  # the folder is gone, or none of its files is Parquet
                if "PATH_NOT_FOUND" not in str(err) and "UNABLE_TO_INFER_SCHEMA" not in str(err):
                    raise
                continue
            out = part if out is None else out.unionByName(part)
    want = {m.dataset: (m.files, m.rows, m.checksum) for m in lines}
    found = out.collect() if out is not None else []
    return sound | {r.dataset for r in found if (r.files, r.rows, r.checksum) == want[r.dataset]}


def ledger_version(spark: SparkSession, path: str) -> int:
    """Number of the last version of the ledger under a folder, 0 before the first."""
    fs, folder = _filesystem(spark, f"{path}/{LEDGER}")
    if not fs.exists(folder):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """``dataset``, ``latest_date`` of the last version; empty before the first."""
    version = ledger_version(spark, path)
    if not version:
        return inline_table(spark, [("", None)], "dataset string, latest_date string").select("dataset", F.col("latest_date").cast("date")).limit(0)
    lines = spark.read.schema(LEDGER_FIELDS).json(f"{path}/{LEDGER}/{version:010d}.json")
    return lines.select("dataset", "latest_date").filter("dataset is not null")


def write_ledger(ledger: DataFrame, path: str, version: int) -> int:
    """Write the ledger as the version after ``version``; ``Conflict`` where another writer has done so first.

    The ledger has one row per dataset, which the driver writes as one file; its name appears at once and only once.
    """
    lines = [json.dumps({"version": version + 1, "dataset": r.dataset, "latest_date": r.latest_date and str(r.latest_date)}) for r in ledger.collect()]
    if not _create(ledger.sparkSession, f"{path}/{LEDGER}/{version + 1:010d}.json", "\n".join(lines) + "\n"):
        raise Conflict(f"version {version + 1} of the ledger exists")
    return version + 1


def commit_ledger(spark: SparkSession, refreshed: DataFrame, path: str, attempts: int = 20) -> int:
    """Bring the last dates of refreshed datasets into the ledger; on a conflict read it anew and try again.

    No entry of another writer is lost: each version is made from the one before it. A date older than the ledger's
    doesn't replace it.
    """
    for _ in range(attempts):
        version = ledger_version(spark, path)
        now = ledger_update(read_ledger(spark, path), refreshed, newer_only=True)
        try:
            return write_ledger(now, path, version)
        except Conflict:
            continue
    raise Conflict(f"no version of the ledger could be written in {attempts} attempts")


def stored_snapshots(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Datasets and dates of the snapshots landed under ``path``, from the partition folders alone."""
    rows = spark.read.parquet(path).select("dataset", "snapshot_date").distinct().collect()  # one row per snapshot
    return sorted((r["dataset"], str(r["snapshot_date"])) for r in rows)


def newest_landed(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest snapshot per dataset under a folder partitioned by ``dataset`` and ``snapshot_date``.

    The newest dates are known before the scan, which then reads those folders only.
    """
    newest = dict(stored_snapshots(spark, path))  # sorted, so the last date of a dataset stays
    rows = spark.read.parquet(path)
    keep = F.lit(False)
    for name, day in newest.items():
        keep = keep | ((F.col("dataset") == name) & (F.col("snapshot_date") == F.lit(day).cast("date")))
    return rows.filter(keep)


def land_snapshot(df: DataFrame, path: str) -> None:
    """Add a snapshot (``dataset``, ``snapshot_date`` and data columns) to a folder; one landed again replaces itself."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dataset", "snapshot_date").parquet(path)
