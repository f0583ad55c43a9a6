"""The registered text queries next to their SQL, and the pipeline's stages on the small tables."""

from __future__ import annotations

import inspect

import pytest

import corpus_pipeline
from carefold.llm import queries
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert [d for d in differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) if d != "EMPTY"] == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_for_each_row_of_the_table(spark, name):
    table, key = ("pages", "page_id") if "html" in name else ("documents", "doc_id")
    want = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).collect())
    got = sorted({r[0] for r in queries.QUERIES[name](spark, FOLDER).select(key).collect()})
    assert got == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = corpus_pipeline.run(spark, FOLDER).collect()
    every = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in out} < every
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns and 0 < kept.count() <= len(every)
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
