"""What queries read and shuffle, from Spark's stage metrics: facts are read few times and shrink before they move."""

from pathlib import Path

import pytest

from checks import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def measured(spark):
    """Run a query; returns (rows that each scan read, most rows that one stage wrote to a shuffle)."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    def run(name):
        before = set(stages())
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        new = [s for i, s in stages().items() if i not in before]
        return [s.inputRecords() for s in new], max([0, *(s.shuffleWriteRecords() for s in new)])

    return run


@pytest.fixture(scope="module")
def facts(spark):
    return spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


@pytest.mark.parametrize(
    "name, most",
    [("j10_semi_derived_set", 1), ("j11_anti_derived_set", 2), ("d6_top_other_series", 1), ("d19_long_history_groups", 2),
     ("s9_latest_good_snapshot", 2), ("a13_exact_median", 2), ("d39_book_out_sheet", 2), ("d8_ranking_table", 1)],
)
def test_fact_scans(measured, facts, name, most):
    # the landed cells of the sheet of d39 outnumber the facts of this small folder, so they count as one more
    assert sum(n >= facts for n in measured(name)[0]) <= most


@pytest.mark.parametrize("name", ["j10_semi_derived_set", "j11_anti_derived_set", "f7_keep_groups", "w3_group_total_on_rows", "d8_ranking_table"])
def test_raw_facts_are_not_shuffled(measured, facts, name):
    assert measured(name)[1] < 0.9 * facts


@pytest.mark.parametrize("name", ["s9_latest_good_snapshot", "j10_semi_derived_set", "c9_fill_down"])
def test_no_nested_loop_join(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fill_down_shuffles_lines_once(spark):
    from waymark.operators.order import fill_down

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).selectExpr("id AS line", "id % 3 AS sheet", "if(id % 7 = 0, id, null) AS label")
        plan = fill_down(rows, ["label"], "line", ["sheet"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the lines, their block ends, and the ends per sheet
    assert plan.count("Exchange hashpartitioning(") <= 4
