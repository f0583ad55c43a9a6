"""Fitted models on targets that are an exact rule of one column, so that the right report is known beforehand."""

import pytest
from pyspark.sql import functions as F

from carefold.operators import feature_selection as FS
from carefold.operators import models as ML
from carefold.plans.domain import Tables
from carefold.operators import sampling as SM

COLS = ["f_quantity", "f_discount", "f_line", "ACS_PCT_INC50"]


@pytest.fixture(scope="module")
def parts(spark):
    """Lines whose target is a late line number, and their class by line number, in three parts."""
    rule = Tables(spark, "/root/testdata/sf0.001").matrix().select(
        "row_key", *COLS, (F.col("f_line") >= 4).cast("int").alias("target"),
        F.when(F.col("f_line") < 3, 0).when(F.col("f_line") < 5, 1).otherwise(2).alias("three"))
    split = SM.split(rule, "row_key", (0.7, 0.15, 0.15)).cache()
    return [SM.take(split, "split", i) for i in range(3)]


def perfect(row):
    return all(abs(row[c] - 1.0) < 1e-9 for c in ("accuracy", "macro_f1", "precision", "recall", "roc_auc", "pr_auc"))


def test_boosted_trees_learn_the_rule(parts):
    train, _, test = parts
    model = ML.fit_gbt(SM.with_class_weight(train, "target"), COLS, "target", weight="weight", n_estimators=3, max_depth=2)
    assert perfect(ML.evaluate(ML.score(model, test, COLS, ["target"]), "target").first())


def test_three_classes_one_against_the_rest_with_early_stopping(parts):
    train, val, test = parts
    marked = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    model = ML.fit_gbt_multiclass(marked.drop("target"), COLS, "three", validation="is_val", n_estimators=3, max_depth=3)
    assert ML.score(model, test, COLS, ["three"]).filter("prediction <> three").count() == 0


def test_forest_and_vote_learn_the_rule(parts):
    train, _, test = parts
    forest = ML.score(ML.fit_random_forest(train, COLS, "target", trees=20, depth=6), test, COLS, ["row_key", "target"])
    boosted = ML.score(ML.fit_gbt(train, COLS, "target", n_estimators=3, max_depth=2), test, COLS, ["row_key", "target"])
    assert perfect(ML.evaluate(ML.soft_vote([forest, boosted], "row_key", "target"), "target").first())


def test_ablation_finds_the_group_that_holds_the_rule(parts):
    fit = lambda d, cols: ML.fit_gbt(d, cols, "target", n_estimators=3, max_depth=2)
    rows = {(r["features"], r["split"]): r for r in ML.ablation(*parts, "target", COLS, fit).collect()}
    assert perfect(rows["clinical", "test"]) and perfect(rows["both", "test"]) and rows["social", "test"]["roc_auc"] < 0.65
    assert rows["clinical", "val"]["n_features"] == 3 and rows["social", "val"]["n_features"] == 1


def test_importance_is_that_of_the_rule(parts):
    train, _, test = parts
    boosted = {r["feature"]: r["score"] for r in FS.gb_importance(train, COLS, "target", trees=1, depth=2).collect()}
    assert abs(boosted["f_line"] - 1.0) < 1e-9
    for table in (FS.rf_importance(train, COLS, "target", trees=10, depth=3), FS.permutation_importance_rf(train, test, COLS, "target", "row_key", trees=10, depth=3, repeats=2)):
        scores = {r["feature"]: r["score"] for r in table.collect()}
        assert max(scores, key=scores.get) == "f_line" and scores["f_line"] > 5 * max(v for c, v in scores.items() if c != "f_line")
    left = [r["feature"] for r in FS.rfe_rf(train, COLS, "target", keep=2, trees=10, depth=3).collect()]
    assert len(left) == 2 and "f_line" in left
