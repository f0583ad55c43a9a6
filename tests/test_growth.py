"""Forms that keep memory and time bounded on larger tables, against the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from carefold.operators import feature_selection as FS
from carefold.operators import models as ML
from carefold.operators import tuning as TU
from carefold.session import small_splits


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 4000
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 9, n).astype(float), "b": rng.normal(0, 5, n).round(3), "c": rng.integers(0, 3, n).astype(float)})
    pdf["y"] = ((pdf["a"] > 4) & (pdf["b"] > 0) | (pdf["c"] == 2)).astype(int)
    return pdf, spark.createDataFrame(pdf).repartition(4).localCheckpoint()


def test_parcels_keep_every_row(table):
    pdf, df = table
    edges = ML.bin_edges(df, ["a", "b", "c"], len(pdf))
    assert [len(edges[c]) for c in "abc"] == [8, 31, 2]
    cells = ML.binned(df.select("a", "b", "c", "y"), ["a", "b", "c"], edges)
    twice = cells.unionByName(cells).unionByName(cells)
    for largest in (None, 2):
        got = ML.parcels(twice, ["a", "b", "c", "y"], largest).toPandas()
        assert got["weight"].sum() == 3 * len(pdf) and got.query("y == 1")["weight"].sum() == 3 * pdf["y"].sum()
        assert len(got) < 3 * len(pdf) and (largest is None or got["weight"].max() <= largest)


def test_forests_on_bins_rank_alike(table, monkeypatch):
    _, df = table
    rank = lambda out: {r["feature"]: r["score"] for r in out.collect()}
    for fit in (lambda: FS.rf_importance(df, ["a", "b", "c"], "y", trees=20), lambda: FS.gb_importance(df, ["a", "b", "c"], "y", trees=5)):
        monkeypatch.setattr(ML, "DRAWN_ROWS", 2_000_000)
        plain = rank(fit())
        monkeypatch.setattr(ML, "DRAWN_ROWS", 1500)
        binned = rank(fit())
        assert all(abs(plain[c] - binned[c]) < 0.05 for c in plain)


def test_swaps_in_a_forest_match_its_predictions(table):
    _, df = table
    model = RandomForestRegressor(featuresCol="features", labelCol="y", numTrees=7, maxDepth=5, seed=1).fit(ML.training_table(df.drop("id"), ["a", "b", "c"]))
    pairs = df.select(F.col("y").cast("double").alias("_y"), F.array("a", "b", "c").alias("_x"), F.array(8 - F.col("a"), -F.col("b"), 2 - F.col("c")).alias("_z"))
    got = {r["_f"]: r["_sse"] for r in FS._loss(model, pairs, 3).collect()}
    for f, name in enumerate(["a", "b", "c"]):
        put = df.withColumn(name, [8 - F.col("a"), -F.col("b"), 2 - F.col("c")][f])
        want = model.transform(ML.assemble(put, ["a", "b", "c"])).agg(F.sum((F.col("prediction") - F.col("y")) ** 2)).first()[0]
        assert got[f] == pytest.approx(want, rel=1e-9)


def test_training_scans_take_small_parts(spark, table, tmp_path):
    _, df = table
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    big = spark.range(3_000_000).select(*[F.rand(i).alias(c) for i, c in enumerate("abcd")], F.lit(1).alias("y"))
    written = ML.training_table(big, list("abcd"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1g")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        with small_splits(spark):
            small = written.select("features").rdd.getNumPartitions()
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1g"
        assert small >= 4 and written.select("y", "features").rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_searches_on_parcels_agree(table, monkeypatch):
    """Trials on bins and weights: the same folds give the same measures to a small error, with class weights too."""
    _, df = table
    rows = df.withColumn("fold", (F.col("id") % 3).cast("int")).withColumn("w", F.when(F.col("y") == 1, 1.5).otherwise(0.5))
    for weight in (None, "w"):
        def trial():
            est = ML.gbt("y", weight=weight, n_estimators=3, max_depth=3)
            model = TU.random_search(rows, ["a", "b", "c"], "y", est, {"learning_rate": [0.1, 0.3], "min_child_samples": [1, 5]}, n=2, folds=3, fold_col="fold")
            return model.avgMetrics, TU.search_table(rows, model).collect()
        monkeypatch.setattr(ML, "DRAWN_ROWS", 2_000_000)
        plain = trial()
        monkeypatch.setattr(ML, "DRAWN_ROWS", 3000)
        binned = trial()
        assert np.allclose(plain[0], binned[0], atol=0.02)
        assert [r["params"] for r in plain[1]] == [r["params"] for r in binned[1]]


def test_search_rows_keep_the_weight_of_all(table, monkeypatch):
    pdf, df = table
    monkeypatch.setattr(ML, "DRAWN_ROWS", 1000)
    out, count = TU.search_rows(df.withColumn("w", F.lit(2.0)), ["a", "c"], "y", folds=4, weight="w")
    got = out.toPandas()
    assert count == TU.ROWS and got[TU.ROWS].sum() == len(pdf) and got["w"].sum() == 2 * len(pdf)
    assert set(got["fold"]) == {0, 1, 2, 3} and len(got) < len(pdf)


def test_scans_of_equal_rows_stay_small(spark, monkeypatch):
    """Rows that a file packs into next to nothing are no more a task for that."""
    monkeypatch.setattr(ML, "FILE_ROWS", 500, raising=False)
    most = []
    for n in (20_000, 100_000):
        written = ML.training_table(spark.range(n).select((F.col("id") % 3).cast("double").alias("a"), F.lit(1).alias("y")), ["a"])
        with ML.small_splits(spark):
            sizes = written.select("y").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == n
        most.append(max(sizes))
    assert max(most) <= 4 * 500
