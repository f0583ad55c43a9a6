"""Plans: no product joins, no Python in native operators, filters and columns reach the scan."""

import re

import pytest
from pyspark.sql import functions as F

from carefold.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()
NATIVE = ["visit_history_report", "wn_01", "jn_01", "jn_09", "jn_13", "dom_01", "dom_03", "dom_05", "ag_08", "ag_12", "ag_20", "ag_27", "ag_31", "ag_32", "ag_35", "dsp_05",
          "rsk_01", "rsk_08", "met_04", "met_05", "tun_05", "spl_01", "bal_01", "smp_02", "imp_02", "imp_03", "job_07", "job_10"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_and_no_products(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for bad in ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas"]:
        assert bad not in text


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["flt_01"](spark, FOLDER))
    assert "EqualTo(o_orderstatus,P)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in text


def test_all_lines_reach_the_code_view(spark):
    """Orders with more lines than a row has codes go on in further rows: no line is lost."""
    from carefold.plans.domain import CODES, Tables

    wide = Tables(spark, FOLDER).wide()
    codes = sum(wide.agg(*[F.count(c).alias(c) for c in CODES]).first())
    assert codes == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_smallest_tables_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,labels", [("imp_02", ("segment", "gender_code")), ("imp_03", ("county_key", "grp")), ("jn_11", ("county_key", "segment"))])
def test_no_row_is_shuffled_by_its_label(spark, name, labels):
    """Also with broadcasts off by default: group values are counted and sent, rows stay where they are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in text
    for label in labels:
        assert f"hashpartitioning({label}#" not in text


@pytest.mark.parametrize("name,label", [("spl_01", "o_orderstatus"), ("spl_02", "o_orderstatus"), ("bal_02", "o_orderstatus"), ("ag_28", "status"), ("jn_11", "segment")])
def test_no_join_by_label_alone(spark, name, label):
    """Sizes and edges of a class reach its rows without a join that brings the class together."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(rf"(SortMergeJoin|ShuffledHashJoin) \[{label}#\d+\]", text)


@pytest.mark.parametrize("name,most", [("rsk_08", 3), ("rsk_03", 3), ("rsk_07", 4)])
def test_risk_scores_take_one_aggregate(spark, name, most):
    """Codes meet their orders, then patients: no exchange per scheme, no repeated rows, no sort-based aggregate."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("Exchange hashpartitioning") <= most and "SortAggregate" not in text and "explode" not in text
