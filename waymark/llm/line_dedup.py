"""Repeated lines, by levelled sorted runs of line hashes.

A run is a sorted table (line hash, number of documents, last document). Every batch of documents becomes a run of
level 0; when a level has ``fanout`` runs they are merged into one run of the next level, so a key is rewritten only
once per level. Each batch is anti-joined with the runs: its new lines are its run, to which the counts and last documents
of lines that the runs already hold are added as updates. So a line is new in one run only, and the rows of new
lines alone tell what the runs hold, without a merge.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.common import landed, map_texts, shared_folder, slices

LEAST_CHARS = 20
#: ``update`` marks the counts of a line that an earlier run holds.
RUN = "line binary, n_docs bigint, last_doc bigint, update boolean"
#: Stands for a missing document id: such rows count as one document, before all others.
NO_ID = -(2**63)

_STRIP = " \t\n\v\f\r"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    """Stripped of the white space of the contract, with A-Z lower-cased."""
    key = line.strip(_STRIP)
    return key.lower() if key.isascii() else key.translate(_LOWER)


def line_hash(line: str, least_chars: int = LEAST_CHARS) -> bytes | None:
    """128-bit hash of the key; None for keys that are too short to be dropped."""
    key = line_key(line)
    return hashlib.blake2b(key.encode(), digest_size=16).digest() if len(key) >= least_chars else None


def document_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """One row (``line``, ``doc``, ``part``) for each distinct long line of a row of documents; ``doc`` is never null.

    ``part`` (a hash of the text) tells the rows of one document apart.
    """

    def columns(texts):
        return {"lines": [list({h for l in t.split("\n") if (h := line_hash(l, least_chars))}) for t in texts]}

    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"), "text")
    return map_texts(ids, columns, "lines array<binary>").select("doc", "part", F.explode("lines").alias("line"))


class LevelledRuns:
    """Sorted runs of line hashes in a shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 4, folder: str | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_folder(spark, "runs")
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, digest: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-run{self.written}"
        self.written += 1
        digest.sortWithinPartitions("line").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*paths)

    def _paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy("line").agg(
            F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"), F.min("update").alias("update")
        )

    def add(self, lines: DataFrame) -> None:
        """Add the lines (``line``, ``doc``) of documents that no earlier batch held; compact full levels.

        The run of a batch holds its new lines, found by an anti-join with the runs, and updates of the others.
        """
        once = lines.groupBy("line", "doc").agg(F.lit(1).alias("_"))
        digest = once.groupBy("line").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last_doc"))
        if self.levels:
            batch = landed(digest, "batch")
            new = self.unseen(batch).withColumn("update", F.lit(False))
            old = batch.join(self.held(), "line", "left_semi").withColumn("update", F.lit(True))
            self._write(new.unionByName(old), 0)
        else:
            self._write(digest.withColumn("update", F.lit(False)), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self._merged(self._read(full)), level + 1)
            level += 1

    def held(self) -> DataFrame:
        """``line``, once each: the lines that the runs hold."""
        paths = self._paths()
        if not paths:
            return self.spark.createDataFrame([], "line binary")
        return self._read(paths).filter(~F.col("update")).select("line")

    def digest(self) -> DataFrame:
        """All runs merged: ``line``, ``n_docs`` and ``last_doc``, one row per line hash."""
        paths = self._paths()
        if not paths:
            return self.spark.createDataFrame([], RUN).drop("update")
        merged = self._read(paths) if len(paths) == 1 else self._merged(self._read(paths))
        return merged.drop("update")

    def unseen(self, lines: DataFrame, least_docs: int = 1) -> DataFrame:
        """Lines (any frame with ``line``) that fewer than ``least_docs`` documents of the runs hold."""
        held = self.held() if least_docs == 1 else self.digest().filter(F.col("n_docs") >= least_docs)
        return lines.join(held, "line", "left_anti")

    def add_new(self, lines: DataFrame) -> DataFrame:
        """The new lines of a batch, after which the batch is part of the runs (for documents that arrive in batches)."""
        new = landed(self.unseen(lines), "new-lines")
        self.add(lines)
        return new


def keep_lines(docs: DataFrame, dropped: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``doc_id``, ``kept`` text, ``n_lines`` and ``n_dropped`` for documents and the dropped hashes of their rows (``doc``, ``part``, ``lines``)."""
    ids = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("part"))
    joined = ids.join(dropped, ["doc", "part"], "left").select("doc_id", "text", "lines")
    schema = "doc_id bigint, kept string, n_lines bigint, n_dropped bigint"
    types = {"doc_id": pa.int64(), "kept": pa.string(), "n_lines": pa.int64(), "n_dropped": pa.int64()}

    def run(batches):
        for part in slices(batches, "text"):
            kept, total, lost = [], [], []
            for text, gone in zip(part.column("text").to_pylist(), part.column("lines").to_pylist()):
                lines = (text or "").split("\n")
                if gone:
                    drop = set(gone)
                    stay = [l for l in lines if line_hash(l, least_chars) not in drop]
                else:
                    stay = lines
                kept.append("\n".join(stay))
                total.append(len(lines))
                lost.append(len(lines) - len(stay))
            columns = [part.column("doc_id"), kept, total, lost]
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values())]
            yield pa.RecordBatch.from_arrays(arrays, list(types))

    return joined.mapInArrow(run, schema)


def dedup_lines(
    docs: DataFrame, least_docs: int = 3, least_chars: int = LEAST_CHARS, batches: int = 4, fanout: int = 2
) -> DataFrame:
    """Drop lines that at least ``least_docs`` documents hold, except in the document with the largest id.

    Documents enter the runs in ``batches`` by a hash of the id. Null and empty texts are one empty line; keys below
    ``least_chars`` code points always stay; rows with the same id count as one document, and rows without an id as
    one document before all others. A document may lose all its lines; its text is then empty.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int")
    lines = landed(document_lines(docs, least_chars).select("line", "doc", "part", batch.alias("batch")), "lines", "batch")
    runs = LevelledRuns(spark, fanout)
    for k in range(batches):
        runs.add(lines.filter(F.col("batch") == k).select("line", "doc"))
    repeated = landed(runs.digest().filter(F.col("n_docs") >= least_docs), "repeated")
    gone = lines.select("line", "doc", "part").join(repeated, "line").filter(F.col("doc") < F.col("last_doc"))
    # gathered by row, so that many rows without an id fill no group; rows whose parts collide drop the same lines
    dropped = gone.groupBy("doc", "part").agg(F.collect_set("line").alias("lines"))
    return keep_lines(docs, dropped, least_chars)
