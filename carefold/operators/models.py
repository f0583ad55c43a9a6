"""Classifiers on ``pyspark.ml``: training is distributed, scores stay in the table."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (Classifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from carefold.operators import metrics as M
from carefold.operators.columns import columns_like
from carefold.functions import constants as C
from carefold.session import SMALL_SPLIT, cut_lineage, small_splits

# Tree settings by their usual names -> pyspark.ml parameter.
PARAM_NAMES = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize", "min_child_samples": "minInstancesPerNode",
               "subsample": "subsamplingRate", "colsample": "featureSubsetStrategy"}


def setting(name: str, value):
    """A setting in the form its parameter takes: the share of columns that a node looks at is text there."""
    return str(value) if PARAM_NAMES.get(name, name) == "featureSubsetStrategy" else value


def assemble(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Vector column; missing values count as 0."""
    filled = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v_{c}") for c in cols])
    vector = VectorAssembler(inputCols=[f"_v_{c}" for c in cols], outputCol=out).transform(filled)
    return vector.drop(*[f"_v_{c}" for c in cols])


#: Rows of one file of a training table. A scan task takes four files at most (each counts as four megabytes of ``SMALL_SPLIT``), so a task's
#: share of a fit stays the same however many rows there are; equal rows pack so well in files that bytes alone would not bound it.
FILE_ROWS = 100_000


def training_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """The feature vector with the label, weight, fold and validation columns, written once to the
    shared folder. Training passes over its input many times, so the table's own lineage (joins, splits,
    hashes) is not repeated on every pass. Rows are dealt by a hash of their features,
    so their layout depends neither on the files nor on the cores, and a retried task deals alike. A file holds at most ``FILE_ROWS`` rows."""
    vectors = assemble(df.withColumn("_deal", F.xxhash64(*cols)), cols)
    slim = vectors.select("features", "_deal", *[n for n, kind in df.dtypes if n not in cols and kind != "string"])
    dealt = slim.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_deal").drop("_deal")
    return cut_lineage(dealt, **{"parquet.block.size": SMALL_SPLIT // 2, "maxRecordsPerFile": FILE_ROWS})


def fit(estimator, table: DataFrame):
    """The fitted estimator. Trees hold their rows as objects, so a task takes a small part of the table, whatever its size."""
    with small_splits(table.sparkSession):
        return estimator.fit(table)


def _fit(estimator, train: DataFrame, cols: list[str]):
    return fit(estimator, training_table(train, cols))


# -- tables in bins -------------------------------------------------------------------------------
#: Bins that the trees sort a feature into (their default), and rows of the sample that the edges come from.
BINS, EDGE_ROWS = 32, 200_000
#: Rows that a forest draws one by one; of a larger table it draws parcels of equal rows, about so many.
DRAWN_ROWS = 2_000_000


def bin_edges(df: DataFrame, cols: list[str], rows: int, seed: int = 1) -> dict[str, list[float]]:
    """Inner edges of at most ``BINS`` bins a column, taken from a bounded sample as the trees themselves do: between all values if there
    are few, else at equal shares."""
    known = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    some = (known if rows <= EDGE_ROWS else known.sample(False, EDGE_ROWS / rows, seed)).toPandas()
    out = {}
    for c in cols:
        values = np.unique(some[c].to_numpy(float))
        if len(values) > BINS:
            values = np.unique(np.quantile(some[c], np.arange(1, BINS) / BINS, method="lower"))
            out[c] = [float(v) for v in values]
        else:
            out[c] = [float(v) for v in (values[1:] + values[:-1]) / 2]
    return out


def binned(df: DataFrame, cols: list[str], edges: dict[str, list[float]]) -> DataFrame:
    """``df`` with the number of its bin in place of every value of ``cols``; missing values count as 0."""
    inf = float("inf")
    filled = df.withColumns({f"_v_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols if edges[c]})
    cut = [c for c in cols if edges[c]]
    if cut:
        filled = Bucketizer(splitsArray=[[-inf, *edges[c], inf] for c in cut], inputCols=[f"_v_{c}" for c in cut], outputCols=[f"_b_{c}" for c in cut]).transform(filled)
    return filled.select(*[(F.col(f"_b_{c}") if c in cut else F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns])


def parcels(df: DataFrame, by: list[str], largest: int | None = None, name: str = "weight") -> DataFrame:
    """``by`` and a weight: equal rows put together, at most ``largest`` a row (None: all), with their number as weight. No
    row is lost, so the sums that trees split by stay the same; there are never more rows than bins can tell apart
    and parcels of that size."""
    cells = df.groupBy(*by).agg(F.count("*").alias("_n"))
    if largest is None:
        return cells.withColumn(name, F.col("_n").cast("double")).drop("_n")
    pieces = F.ceil(F.col("_n") / F.lit(largest)).cast("int")
    return cells.withColumn(name, F.col("_n") / pieces).withColumn("_p", F.explode(F.sequence(F.lit(1), pieces))).drop("_n", "_p")


def fit_logistic(train: DataFrame, cols: list[str], label: str, weight: str | None = None, scale: bool = True, **params):
    """Logistic regression on standardised features."""
    lr = LogisticRegression(featuresCol="scaled" if scale else "features", labelCol=label, **params)
    if weight:
        lr = lr.setWeightCol(weight)
    stages = ([StandardScaler(inputCol="features", outputCol="scaled", withMean=True)] if scale else []) + [lr]
    return _fit(Pipeline(stages=stages), train, cols)


def fit_random_forest(train: DataFrame, cols: list[str], label: str, trees: int = 300, depth: int = 15, leaf: int = 1, weight: str | None = None, seed: int = 42):
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return _fit(rf.setWeightCol(weight) if weight else rf, train, cols)


def gbt(label: str, weight: str | None = None, validation: str | None = None, seed: int = 42, **params) -> GBTClassifier:
    """Boosted trees; settings may use the usual names of boosting libraries."""
    est = GBTClassifier(featuresCol="features", labelCol=label, seed=seed, **{PARAM_NAMES.get(k, k): setting(k, v) for k, v in params.items()})
    if weight:
        est = est.setWeightCol(weight)
    return est.setValidationIndicatorCol(validation) if validation else est


def fit_gbt(train: DataFrame, cols: list[str], label: str, weight: str | None = None, validation: str | None = None, **params):
    return _fit(gbt(label, weight, validation, **params), train, cols)


def fit_one_vs_rest(train: DataFrame, cols: list[str], label: str, base: Classifier, parallelism: int = 3):
    return _fit(OneVsRest(classifier=base, featuresCol="features", labelCol=label, parallelism=parallelism), train, cols)


def fit_gbt_multiclass(train: DataFrame, cols: list[str], label: str, **params):
    """One boosted model per class against the rest; training stops when the marked validation rows
    stop improving."""
    return fit_one_vs_rest(train, cols, label, gbt(label, **params))


def fit_mlp(train: DataFrame, cols: list[str], label: str, hidden: tuple[int, ...] = (100,), classes: int = 2, scale: bool = True, seed: int = 42, **params):
    mlp = MultilayerPerceptronClassifier(featuresCol="scaled" if scale else "features", labelCol=label, layers=[len(cols), *hidden, classes], seed=seed, **params)
    stages = ([StandardScaler(inputCol="features", outputCol="scaled", withMean=True)] if scale else []) + [mlp]
    return _fit(Pipeline(stages=stages), train, cols)


def score(model, df: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns plus prediction and, where the model gives one, the probability of class 1."""
    out = model.transform(assemble(df, cols))
    extra = [F.col("prediction").cast("int").alias("prediction")]
    if "probability" in out.columns:
        extra.append(vector_to_array("probability")[1].alias("probability"))
    return out.select(*keep, *extra)


def soft_vote(scored: list[DataFrame], key: str, label: str) -> DataFrame:
    """Mean probability of several scored tables of the same rows. The tables are stacked and
    averaged by key: one shuffle for any number of models."""
    stacked = scored[0].select(key, label, "probability")
    for s in scored[1:]:
        stacked = stacked.unionByName(s.select(key, label, "probability"))
    mean = stacked.groupBy(key).agg(F.min(label).alias(label), F.avg("probability").alias("probability"))
    return mean.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))


def evaluate(scored: DataFrame, label: str, threshold: float | None = None) -> DataFrame:
    """One row: accuracy, macro F1, precision and recall of class 1 (at the threshold when given), ROC-AUC and average precision."""
    scored = cut_lineage(scored)  # the model runs once, not once per measure
    s = scored if threshold is None else scored.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    summary = M.report_summary(M.class_report(s, label))
    out = M.accuracy(s, label).withColumn("_r", summary.select(F.struct("*")).scalar())
    out = out.select("accuracy", "_r.macro_f1", "_r.precision", "_r.recall")
    if "probability" in scored.columns:
        curves = M.curve_measures(s, label).select(F.struct("*")).scalar()
        out = out.withColumn("_c", curves).select("*", F.col("_c.roc_auc").alias("roc_auc"), F.col("_c.average_precision").alias("pr_auc")).drop("_c")
    return out


def refit_and_score(fit, train: DataFrame, val: DataFrame, test: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Fit on train, choose the threshold on validation, report validation and test."""
    model = fit(train)
    scored = cut_lineage(score(model, val, cols, [label]))
    t = M.find_threshold(scored, label)
    rows = [evaluate(d, label, t).withColumn("split", F.lit(n)) for n, d in [("val", scored), ("test", score(model, test, cols, [label]))]]
    return rows[0].unionByName(rows[1]).withColumn("threshold", F.lit(t))


def ablation(train: DataFrame, val: DataFrame, test: DataFrame, label: str, cols: list[str], fit) -> DataFrame:
    """Test report of models on clinical columns only, social columns only, and both.
    ``fit(train, cols)`` returns a model."""
    social = [c for c in columns_like(train.select(*cols), prefix=C.SDOH_PREFIXES)]
    groups = {"clinical": [c for c in cols if c not in social], "social": social, "both": cols}
    rows = None
    for name, part in groups.items():
        out = refit_and_score(lambda d, p=part: fit(d, p), train, val, test, part, label).withColumns(
            {"features": F.lit(name), "n_features": F.lit(len(part))})
        rows = out if rows is None else rows.unionByName(out)
    return rows
