"""The registered queries: SQL where there is any, the pipeline stage by stage."""

import os

import pytest

import corpus_pipeline
from check import compare, oracle_connection
from tidemark.llm.common import read_table
from tidemark.llm.queries import QUERIES, SQL

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    good, note = compare(spark, oracle_connection(SF_DIR), SF_DIR, name, QUERIES[name], SQL[name])
    assert good, note


def test_the_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages_keep_columns_and_shrink_or_mix(spark):
    docs = first = read_table(spark, SF_DIR, "documents")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == first.columns, name
        counts.append(docs.count())
    assert first.count() >= counts[0] >= counts[1] >= counts[2] > 0
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert len(rows) == counts[-1] and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for table in ("documents", "benchmark"):
        read_table(spark, SF_DIR, table).where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_pairing_of_everything(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, query in QUERIES.items():
            plan = query(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
