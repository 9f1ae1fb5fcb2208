"""Totals that are kept up to date as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from waymark.operators.aggregates import total


def refresh_totals(
    stream: DataFrame, by: list[str], values: list[str], store: Callable[[DataFrame, int], None], state: str, once: list[str] | None = None
) -> int:
    """Add all files that have arrived to the sums by keys and hand the new totals to ``store``; the number of batches.

    ``stream`` is a streaming frame of files, ``state`` a shared folder that keeps what was read and the sums between calls.
    ``store`` gets all totals and the number of the batch; after a failure it may get the same batch again, with the same
    totals, so it must replace what it wrote for that number. Late files count like any other. With ``once``, rows that
    repeat these columns count once, in whatever file they come; the state then holds one row per value of them. Nothing is
    stored if no file has arrived.
    """
    rows = stream.dropDuplicates(once) if once else stream
    stored: list[int] = []

    def put(totals: DataFrame, batch: int) -> None:
        store(totals, batch)
        stored.append(batch)

    sums = total(rows, by, *values)
    query = sums.writeStream.outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True)
    query.foreachBatch(put).start().awaitTermination()
    return len(stored)
