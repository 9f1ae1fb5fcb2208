"""Totals over arriving files equal those of a batch over the same files."""

import pytest
from pyspark.sql import functions as F

from waymark.operators.aggregates import total
from waymark.streaming.totals import refresh_totals

ROWS = "id bigint, month string, place string, people bigint"


@pytest.mark.parametrize("once", [None, ["id"]])
def test_arriving_files_give_the_totals_of_a_batch(spark, rows, tmp_path, once):
    landing, state, target = (str(tmp_path / n) for n in ("landing", "state", "totals"))
    made = [
        [(1, "2024-01", "A", 5), (2, "2024-02", "A", 7), (3, "2024-02", None, None)],
        [(4, "2024-03", "B", 1)] + [(10 + i, "2024-03", "A", i) for i in range(40)],
        [(5, "2024-01", "A", 2), (6, "2024-01", None, 3)],  # late
        [(4, "2024-03", "B", 1), (7, "2024-03", "B", None)],  # a row comes again
    ]

    def store(totals, batch):
        totals.write.mode("overwrite").parquet(f"{target}/{batch:06d}")

    def refresh():
        # a plan of its own each time, as after a restart
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 2).parquet(landing)
        return refresh_totals(stream, ["month", "place"], ["people"], store, state, once)

    for part in made:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(landing)
        assert refresh() == 1
        newest = max(p.name for p in (tmp_path / "totals").iterdir())
        read = spark.read.schema(ROWS).parquet(landing)
        want = total(read.dropDuplicates(once) if once else read, ["month", "place"], "people")
        assert rows(spark.read.parquet(f"{target}/{newest}")) == rows(want)
    assert refresh() == 0
    doubled = read.filter(F.col("place") == "B").agg(F.sum("people")).first()[0]
    kept = spark.read.parquet(f"{target}/{newest}").filter(F.col("place") == "B").agg(F.sum("people")).first()[0]
    assert (doubled, kept) == (2, 1 if once else 2)
