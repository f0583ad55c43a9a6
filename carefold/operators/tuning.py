"""Hyper-parameter search with seeded draws over ``CrossValidator`` and ``TrainValidationSplit``."""

from __future__ import annotations

import math
import random

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import DataFrame, functions as F

from carefold.operators import models as ML
from carefold.operators.models import PARAM_NAMES, setting

# Search spaces (fixed values). Leaves and regularisation have no counterpart in pyspark.ml trees;
# the share of columns is drawn per node there.
RANDOM_SPACE = {"learning_rate": [0.01, 0.05, 0.1, 0.2], "n_estimators": [100, 200, 500], "max_depth": [5, 10, 15], "subsample": [0.6, 0.8, 1.0],
                "min_child_samples": [10, 20, 50], "colsample": [0.6, 0.8, 1.0]}
RANGE_SPACE = {"n_estimators": (300, 1200, "int"), "learning_rate": (0.01, 0.3, "log"), "min_child_samples": (50, 300, "int"), "subsample": (0.4, 1.0, "float"), "colsample": (0.4, 1.0, "float")}
CHOICE_SPACE = {"n_estimators": [100, 300, 500], "learning_rate": [0.05, 0.1, 0.2], "max_depth": [5, 10], "min_child_samples": [50, 100], "subsample": [0.8, 1.0], "colsample": [0.8, 1.0]}


def _value(rng: random.Random, spec):
    if isinstance(spec, list):
        return rng.choice(spec)
    lo, hi, kind = spec
    if kind == "int":
        return rng.randint(lo, hi)
    if kind == "log":
        return math.exp(rng.uniform(math.log(lo), math.log(hi)))
    return rng.uniform(lo, hi)


def draws(estimator, space: dict, n: int, seed: int = 42) -> list[dict]:
    """``n`` seeded parameter maps from lists of choices or (low, high, kind) ranges."""
    rng = random.Random(seed)
    return [{estimator.getParam(PARAM_NAMES.get(k, k)): setting(k, _value(rng, spec)) for k, spec in space.items()} for _ in range(n)]


#: Column with the number of rows that a parcel stands for.
ROWS = "_rows"
#: Models fitted at once; one by one when a table is so large that each fills the cluster.
AT_ONCE = 4


def search_rows(train: DataFrame, cols: list[str], label: str, folds: int | None = None, fold_col: str | None = None, weight: str | None = None):
    """(training table, name of its row numbers or None). A search fits many models on one table, so a table of more than
    ``ML.DRAWN_ROWS`` rows is put into the trees' bins first, equal rows of a fold as parcels. Every row counts in fits and measures; rows are
    dealt to folds before that. A leaf's least size counts parcels there, which is at least that many rows. ``subsample`` draws parcels."""
    rows = train.count()
    if rows <= ML.DRAWN_ROWS:
        return ML.training_table(train, cols), None
    others = [label, *([weight] if weight else [])]
    if folds and not fold_col:
        fold_col = "fold"
        train = train.withColumn(fold_col, F.pmod(F.xxhash64(*train.columns), F.lit(folds)).cast("int"))
    if fold_col:
        others.append(fold_col)
    slim = train.select(*cols, *others)
    parts = ML.parcels(ML.binned(slim, cols, ML.bin_edges(slim, cols, rows)), [*cols, *others], -(-rows // ML.DRAWN_ROWS), ROWS)
    if weight:
        parts = parts.withColumn(weight, F.col(weight) * F.col(ROWS))
    return ML.training_table(parts, cols), ROWS


def _search(kind, train: DataFrame, cols: list[str], label: str, estimator, maps: list[dict], parallelism: int, folds: int | None = None,
            fold_col: str | None = None, **params):
    weight = estimator.getOrDefault("weightCol") if estimator.isSet("weightCol") else None
    table, rows = search_rows(train, cols, label, folds, fold_col, weight)
    evaluator = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    if rows:
        evaluator = evaluator.setWeightCol(rows)
        estimator = estimator if weight else estimator.copy().setWeightCol(rows)
        fold_col = fold_col or ("fold" if folds else None)
        parallelism = parallelism if table.count() <= AT_ONCE * ML.DRAWN_ROWS else 1
    search = kind(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, parallelism=parallelism, **({"numFolds": folds} if folds else {}), **params)
    return ML.fit(search.setFoldCol(fold_col) if fold_col else search, table)


def random_search(train: DataFrame, cols: list[str], label: str, estimator, space: dict, n: int = 50, folds: int = 3, seed: int = 42,
                  fold_col: str | None = None, parallelism: int = AT_ONCE) -> CrossValidatorModel:
    """Best of ``n`` draws by mean cross-validated AUC; ``fold_col`` supplies stratified folds."""
    return _search(CrossValidator, train, cols, label, estimator, draws(estimator, space, n, seed), parallelism, folds, fold_col, seed=seed)


def grid_search(train: DataFrame, cols: list[str], label: str, estimator, grid: dict[str, list], folds: int = 3, seed: int = 42, parallelism: int = AT_ONCE) -> CrossValidatorModel:
    builder = ParamGridBuilder()
    for k, values in grid.items():
        builder = builder.addGrid(estimator.getParam(PARAM_NAMES.get(k, k)), [setting(k, v) for v in values])
    return _search(CrossValidator, train, cols, label, estimator, builder.build(), parallelism, folds, seed=seed)


def validation_search(train: DataFrame, cols: list[str], label: str, estimator, choices: dict, n: int = 20, seed: int = 42, parallelism: int = AT_ONCE) -> TrainValidationSplitModel:
    """Best of ``n`` draws on one validation part; set the estimator's weight column for the weighted
    variant."""
    return _search(TrainValidationSplit, train, cols, label, estimator, draws(estimator, choices, n, seed), parallelism, trainRatio=8 / 9, seed=seed)


def search_table(train: DataFrame, model) -> DataFrame:
    """(trial, metric, parameters) of a finished search."""
    values = model.avgMetrics if hasattr(model, "avgMetrics") else model.validationMetrics
    rows = [(i, float(v), {p.name: str(x) for p, x in m.items()}) for i, (v, m) in enumerate(zip(values, model.getEstimatorParamMaps()))]
    return train.sparkSession.createDataFrame(rows, "trial int, metric double, params map<string,string>")
