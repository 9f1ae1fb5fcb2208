"""The corpus pipeline against brute force, and the registered queries against their SQL."""

import collections
from pathlib import Path

import pytest

import corpus_pipeline
from run_checks import compare, database
from llm_helpers import classes_of, contaminated, targets_of
from waymark.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables absent")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, con, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), con, queries.ORACLES[name]).startswith("ok")


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, by name."""
    from waymark.llm.common import landed

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = landed(stage(spark, docs, FOLDER), name)
        out[name] = docs.collect()
    return out


def test_stages_return_the_columns_of_documents(stages):
    for name, rows in stages.items():
        assert rows and list(rows[0].asDict())[:5] == corpus_pipeline.COLUMNS, name


def test_one_document_of_each_group_stays(stages):
    texts = {r.doc_id: r.text for r in stages["toxicity"]}
    assert sorted(r.doc_id for r in stages["near_dedup"]) == sorted(set(classes_of(texts).values()))


def test_contaminated_documents_go(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    want = sorted(r.doc_id for r in stages["near_dedup"] if not contaminated(r.text, items))
    assert sorted(r.doc_id for r in stages["decontamination"]) == want


def test_mix_and_shards(stages):
    before, after, longest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in stages["decontamination"]:
        before[r.source] += len(r.text.split())
        longest[r.source] = max(longest[r.source], len(r.text.split()))
    assert {r[:5] for r in stages["mixing"]} <= {r[:5] for r in stages["decontamination"]}  # whole documents
    for r in stages["mixing"]:
        after[r.source] += len(r.text.split())
    for source, target in targets_of(before).items():
        assert abs(after[source] - target) <= 64 + longest[source] / 2
    assert len(stages["sharding"]) == len(stages["mixing"])
    assert all(0 <= r.shard < 16 for r in stages["sharding"])
    assert len({(r.doc_id, r.shard) for r in stages["sharding"]}) == len({r.doc_id for r in stages["mixing"]})


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages["sharding"]))
    assert sharding.MULTIPLIER % 4 == 1
