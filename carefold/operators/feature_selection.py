"""Feature selection. Statistics come from one or two aggregates over the table; the driver only ever
sees one value per column, pair of columns or fitted model."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from carefold.functions.scalars import hash_bucket
from carefold.operators import ordered
from carefold.operators.columns import numeric_columns
from carefold.operators.neighbours import nearest_of_points
from carefold.operators.profile import corr_matrix, dominant_numeric, dominant_share, target_corr
from carefold.operators import models as ML
from carefold.operators.models import training_table
from carefold.session import cut_lineage


# -- filters ------------------------------------------------------------------------------------
def drop_dominant(df: DataFrame, cols: list[str], t: float = 0.99) -> list[str]:
    """Columns that survive: no single value reaches share ``t`` of the non-null rows and there is a
    non-null row. Text columns are counted, numeric ones use the median rule."""
    numeric = set(numeric_columns(df))
    gone = set(dominant_numeric(df, [c for c in cols if c in numeric], t))
    text = [c for c in cols if c not in numeric]
    if text:
        shares = {r["column"]: r["share"] for r in dominant_share(df, text).collect()}
        gone |= {c for c in text if shares.get(c) is None or shares[c] >= t}
    return [c for c in cols if c not in gone]


def drop_correlated(df: DataFrame, cols: list[str], t: float = 0.95) -> list[str]:
    """Columns that survive: j goes when any earlier i, kept or not, has abs(r) above ``t``."""
    hits = corr_matrix(df, cols).filter(F.abs("r") > t).select("j").distinct()
    gone = {r["j"] for r in hits.collect()}
    return [c for c in cols if c not in gone]


def drop_weak(df: DataFrame, cols: list[str], target: str, t: float = 0.01) -> list[str]:
    """Columns that survive after a 0-fill: abs(r) with the target is at least ``t``, or undefined."""
    weak = target_corr(df.fillna(0, subset=cols), cols, target).filter(F.abs("r") < t)
    gone = {r["feature"] for r in weak.collect()}
    return [c for c in cols if c not in gone]


def select_features(df: DataFrame, target: str, cols: list[str] | None = None, dominant: float = 0.99, correlated: float = 0.95,
                    weak: float = 0.01) -> dict[str, list[str]]:
    """The three stages in order; the surviving columns after each one."""
    cols = cols or [c for c in df.columns if c != target]
    stages = {"start": cols}
    stages["dominant"] = drop_dominant(df, cols, dominant)
    stages["correlated"] = drop_correlated(df, stages["dominant"], correlated)
    stages["target"] = drop_weak(df, stages["correlated"], target, weak)
    return stages


def variance_threshold(df: DataFrame, cols: list[str], t: float = 0.1) -> DataFrame:
    """(feature, score): population variance of the columns above the threshold."""
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.var_pop(c).alias("score")) for c in cols])
    return df.agg(rows.alias("r")).select(F.inline("r")).filter(F.col("score") > t)


#: Scores that agree to so many places are a tie, which goes to the first column: sums depend on the order of the rows in the last digits.
TIE_PLACES = 10


# -- model based --------------------------------------------------------------------------------
def _ranking(df: DataFrame, method: str, kind: str, pairs: list[tuple[str, float]]) -> DataFrame:
    rows = [(method, kind, f, float(s) if s is not None else None) for f, s in pairs]
    return df.sparkSession.createDataFrame(rows, "method string, score_type string, feature string, score double")


def _weighted(df: DataFrame, cols: list[str], target: str, drawn: bool) -> tuple[DataFrame, dict[str, list[float]] | None]:
    """(training table with a weight, edges of its bins). Trees see bins alone, so a table of more than ``ML.DRAWN_ROWS`` rows is
    trained on as bins and weights: what a tree keeps in memory and walks through on each level is then bounded by the bins and
    not by the rows. ``drawn``: the estimator draws rows, which takes parcels of a bounded size. Smaller tables stay as they are."""
    slim = df.select(*cols, target)
    rows = slim.count()
    if rows <= ML.DRAWN_ROWS:
        return training_table(slim.withColumn("weight", F.lit(1.0)), cols), None
    edges = ML.bin_edges(slim, cols, rows)
    parts = ML.parcels(ML.binned(slim, cols, edges), [*cols, target], -(-rows // ML.DRAWN_ROWS) if drawn else None)
    return training_table(parts, cols), edges


def rf_importance(df: DataFrame, cols: list[str], target: str, trees: int = 100, depth: int = 5, seed: int = 1) -> DataFrame:
    table, _ = _weighted(df, cols, target, drawn=True)
    model = ML.fit(RandomForestRegressor(featuresCol="features", labelCol=target, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed), table)
    return _ranking(df, "Random Forest Importance", "Importance", list(zip(cols, model.featureImportances.toArray())))


def gb_importance(df: DataFrame, cols: list[str], target: str, trees: int = 100, depth: int = 3, seed: int = 1) -> DataFrame:
    table, _ = _weighted(df, cols, target, drawn=False)
    model = ML.fit(GBTRegressor(featuresCol="features", labelCol=target, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed), table)
    return _ranking(df, "GB Importance", "Importance", list(zip(cols, model.featureImportances.toArray())))


class ForestMasks:
    """A fitted regression forest for swaps of single values: for every feature and stretch between its thresholds the leaves of each
    tree that such a value leaves open, as bits. The bits that all features leave open are the one leaf a row falls into, so a
    swap costs one step a tree. Up to 32 leaves a tree."""

    def __init__(self, text: str, features: int):
        tokens = iter(re.findall(r"If \(feature (\d+) <= (\S+)\)|(Else)|Predict: (\S+)", text))
        leaves, splits = [], []

        def walk(tree: int) -> None:
            f, t, _, value = next(tokens)
            if value:
                leaves[tree].append(float(value))
                return
            start = len(leaves[tree])
            walk(tree)
            middle = len(leaves[tree])
            next(tokens)  # Else
            walk(tree)
            splits.append((tree, int(f), float(t), start, middle, len(leaves[tree])))

        for tree in range(len(re.findall(r"Tree \d+ \(weight", text))):
            leaves.append([])
            walk(tree)
        self.most_leaves = max(map(len, leaves))
        if self.most_leaves > 32:
            return
        every = np.array([(1 << len(x)) - 1 for x in leaves], np.uint32)
        self.edges = [np.unique([t for _, g, t, *_ in splits if g == f]) for f in range(features)]
        self.open = [np.tile(every, (len(e) + 1, 1)) for e in self.edges]
        for tree, f, t, start, middle, end in splits:
            at = int(np.searchsorted(self.edges[f], t)) + 1
            self.open[f][:at, tree] &= np.uint32(0xFFFFFFFF ^ (1 << end) - (1 << middle))
            self.open[f][at:, tree] &= np.uint32(0xFFFFFFFF ^ (1 << middle) - (1 << start))
        self.values = np.concatenate([np.r_[x, np.zeros(32 - len(x))] for x in leaves])
        self.first = np.arange(len(leaves)) * 32 - 127

    def masks(self, f: int, x: np.ndarray) -> np.ndarray:
        return self.open[f][np.searchsorted(self.edges[f], x)]

    def predict(self, masks: np.ndarray) -> np.ndarray:
        """The mean over the trees; the place of a single bit is the exponent of its number."""
        return self.values[(masks.astype(np.float32).view(np.int32) >> 23) + self.first].mean(axis=1)

    def swapped(self, x: np.ndarray, z: np.ndarray):
        """For every feature the predictions of the rows ``x`` with the value of ``z`` in its place."""
        own = [self.masks(f, x[:, f]) for f in range(x.shape[1])]
        after = [None] * len(own)  # what the features behind one leave open
        for f in range(len(own) - 2, -1, -1):
            after[f] = own[f + 1] if after[f + 1] is None else own[f + 1] & after[f + 1]
        before = None
        for f in range(len(own)):
            m = self.masks(f, z[:, f])
            for rest in (before, after[f]):
                m = m if rest is None else m & rest
            yield self.predict(m)
            before = own[f] if before is None else before & own[f]


def _forest_loss(forest: ForestMasks, pairs: DataFrame, features: int) -> DataFrame:
    held = pairs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        total = np.zeros(features)
        for batch in batches:
            y, x, z = (batch.column(i) for i in range(3))
            y = y.to_numpy(zero_copy_only=False)
            x, z = (c.flatten().to_numpy(zero_copy_only=False).reshape(-1, features) for c in (x, z))
            for at in range(0, len(y), 1024):
                part = slice(at, at + 1024)
                total += [np.nansum((p - y[part]) ** 2) for p in held.value.swapped(x[part], z[part])]
        yield pa.RecordBatch.from_arrays([pa.array(range(features), pa.int32()), pa.array(total)], names=["_f", "_sse"])

    return pairs.select("_y", "_x", "_z").mapInArrow(run, "_f int, _sse double").groupBy("_f").agg(F.sum("_sse").alias("_sse"))


def _loss(model, pairs: DataFrame, features: int) -> DataFrame:
    """(_f, _sse): the squared errors over ``pairs (_y, _x, _z)`` when feature ``_f`` of ``_x`` takes its value in ``_z``. Linear models
    and forests of small trees change a prediction by that value alone; other models score every changed row."""
    if isinstance(model, LinearRegressionModel):
        w = [float(v) for v in model.coefficients.toArray()]
        x, z = ([F.get(c, F.lit(f)) for f in range(features)] for c in ("_x", "_z"))
        error = sum((v * c for v, c in zip(w, x)), F.lit(float(model.intercept))) - F.col("_y")
        apart = pairs.select(error.alias("_e"), *[(v * (b - a)).alias(f"_d{f}") for f, (v, a, b) in enumerate(zip(w, x, z))])
        sums = apart.agg(F.array(*[F.sum((F.col("_e") + F.col(f"_d{f}")) ** 2) for f in range(features)]).alias("s"))
        return sums.select(F.posexplode("s").alias("_f", "_sse")).filter(F.col("_sse").isNotNull())
    forest = ForestMasks(model.toDebugString, features) if isinstance(model, RandomForestRegressionModel) else None
    if forest and forest.most_leaves <= 32:
        return _forest_loss(forest, pairs, features)
    swapped = pairs.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(features - 1)))).withColumn(
        "features", array_to_vector(F.transform("_x", lambda x, i: F.when(i == F.col("_f"), F.get("_z", i)).otherwise(x))))
    return model.transform(swapped).groupBy("_f").agg(F.sum((F.col("prediction") - F.col("_y")) ** 2).alias("_sse"))


def permutation_importance(model, test: DataFrame, cols: list[str], target: str, key: str, repeats: int = 10, seed: int = 1) -> DataFrame:
    """(feature, score): mean loss of R2 when one column takes the values of another row.

    A permutation pairs the rows numbered in one hash order with the rows numbered in another. All features share the pairing of
    a repeat. The test rows are written once; all orders are numbered in one shuffle and meet by number in a second."""
    arr = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols])
    base = cut_lineage(test.select(F.col(key).alias("_key"), F.col(target).cast("double").alias("_y"), arr.alias("_x")))
    orders = F.array(hash_bucket(F.col("_key")), *[hash_bucket(F.col("_key"), salt=f"#p{seed}.{r}") for r in range(repeats)])
    turns = base.select("*", F.posexplode(orders).alias("_turn", "_h"))
    ranked = ordered.numbered(turns, "_h", "_key", "_rn", ["_turn"]).select("_rn", "_turn", "_y", "_x").repartition("_rn")
    met = ranked.groupBy("_rn").agg(F.any_value(F.when(F.col("_turn") == 0, F.struct("_y", "_x")), True).alias("_own"),
                                    F.collect_list(F.when(F.col("_turn") > 0, F.col("_x"))).alias("_others"))
    pairs = met.select("_own._y", "_own._x", F.explode("_others").alias("_z"))
    plain = _loss(model, base.withColumn("_z", F.col("_x")), len(cols)).filter("_f = 0").select("_sse").scalar()
    spread = base.agg(F.var_pop("_y") * F.count("_y")).scalar()
    names = F.array(*[F.lit(c) for c in cols])
    return _loss(model, pairs, len(cols)).select(F.get(names, F.col("_f")).alias("feature"),
                                                 F.try_divide(F.col("_sse") / repeats - plain, spread).alias("score"))


def permutation_importance_rf(train: DataFrame, test: DataFrame, cols: list[str], target: str, key: str, trees: int = 100, depth: int = 5,
                              repeats: int = 10, seed: int = 1) -> DataFrame:
    table, edges = _weighted(train, cols, target, drawn=True)
    model = ML.fit(RandomForestRegressor(featuresCol="features", labelCol=target, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed), table)
    return permutation_importance(model, ML.binned(test, cols, edges) if edges else test, cols, target, key, repeats, seed)


def permutation_importance_ridge(train: DataFrame, test: DataFrame, cols: list[str], target: str, key: str, alpha: float = 1.0,
                                 repeats: int = 10, seed: int = 1) -> DataFrame:
    """The penalty is ``alpha`` times the squared coefficients next to the plain sum of squared errors. The solver divides its own
    by the rows and by the target's deviation, which is undone here."""
    row = train.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    model = LinearRegression(featuresCol="features", labelCol=target, elasticNetParam=0.0, regParam=alpha * (row["s"] or 1.0) / max(1, row["n"]),
                             standardization=False).fit(training_table(train, cols))
    return permutation_importance(model, test, cols, target, key, repeats, seed)


def rfe_rf(df: DataFrame, cols: list[str], target: str, keep: int = 5, trees: int = 100, depth: int = 5, seed: int = 1) -> DataFrame:
    """Refit without the weakest feature until ``keep`` are left; the training table is written once and sliced."""
    left = list(cols)
    table, _ = _weighted(df, cols, target, drawn=True)
    while True:
        some = VectorSlicer(inputCol="features", outputCol="some", indices=[cols.index(c) for c in left]).transform(table)
        model = ML.fit(RandomForestRegressor(featuresCol="some", labelCol=target, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed), some)
        scores = dict(zip(left, model.featureImportances.toArray()))
        if len(left) <= keep:
            return _ranking(df, "RFE (RF)", "Importance", list(scores.items()))
        left.remove(min(left, key=lambda c: scores[c]))


# -- ridge on Gram matrices ----------------------------------------------------------------------
def gram(df: DataFrame, cols: list[str], target: str, fold: str | None = None) -> dict[int, np.ndarray]:
    """Per fold the (p + 2) square matrix Z'Z with Z = [X, y, 1]. The columns are centred on their means over the whole
    table first, so that large offsets cost no digits; a ridge fit with an intercept does not depend on them. Null and NaN
    count as 0, as before."""
    names = [*cols, target]
    plain = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in names]
    means = df.select(*plain).agg(*[F.avg(c).alias(c) for c in names]).first()
    typed = [(p - F.lit(float(means[c] or 0.0))).alias(c) for p, c in zip(plain, names)]
    part = (F.col(fold).cast("int") if fold else F.lit(0)).alias("_fold")
    size = len(names) + 1

    def products(batches):
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for f, rows in pdf.groupby("_fold"):
                z = np.column_stack([rows[names].to_numpy(float), np.ones(len(rows))])
                sums[int(f)] = sums.get(int(f), 0) + z.T @ z
        for f, m in sums.items():
            i, j = np.indices(m.shape)
            yield pd.DataFrame({"fold": f, "i": i.ravel(), "j": j.ravel(), "v": m.ravel()})

    summed = df.select(*typed, part).mapInPandas(products, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in summed.collect():
        out.setdefault(r["fold"], np.zeros((size, size)))[r["i"], r["j"]] = r["v"]
    return out


def lasso_from_gram(g: np.ndarray, alpha: float, tol: float = 1e-13, sweeps: int = 100_000) -> np.ndarray:
    """Coefficients that minimise half the mean squared error plus ``alpha`` times their absolute sum, one coordinate at a time.

    Sweeps end when none moves the fit by more than ``tol`` deviations of the target. A constant column gets 0."""
    n, p = g[-1, -1], len(g) - 2
    cov = (g[:-1, :-1] - np.outer(g[:-1, -1], g[:-1, -1]) / n) / n
    xx, xy, spread = cov[:p, :p], cov[:p, p], np.sqrt(cov[p, p])
    w = np.zeros(p)
    for _ in range(sweeps):
        moved = 0.0
        for j in range(p):
            if xx[j, j] <= 0:
                continue
            pull = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            new = np.sign(pull) * max(abs(pull) - alpha, 0.0) / xx[j, j]
            moved = max(moved, abs(new - w[j]) * np.sqrt(xx[j, j]))
            w[j] = new
        if moved <= tol * spread:
            return w
    raise ArithmeticError("the coefficients did not settle")


def lasso(df: DataFrame, cols: list[str], target: str, alpha: float = 0.01) -> DataFrame:
    """Non-zero coefficients of an L1 fit with an intercept. The table is read twice, for its means and its moments; the fit needs
    no further pass. An empty table has none; nulls and NaN count as 0."""
    moments = gram(df, cols, target)
    weights = lasso_from_gram(moments[0], alpha) if moments else []
    return _ranking(df, "Lasso", "Coefficient", [(c, w) for c, w in zip(cols, weights) if w != 0])


def ridge_from_gram(g: np.ndarray, idx: list[int], alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of a ridge fit on the chosen columns."""
    n, y = g[-1, -1], len(g) - 2
    mean_x, mean_y = g[idx, -1] / n, g[y, -1] / n
    xx = g[np.ix_(idx, idx)] - n * np.outer(mean_x, mean_x)
    xy = g[idx, y] - n * mean_x * mean_y
    w = np.linalg.solve(xx + alpha * np.eye(len(idx)), xy)
    return w, float(mean_y - mean_x @ w)


def r2_from_gram(g: np.ndarray, idx: list[int], w: np.ndarray, b: float) -> float:
    y, v = len(g) - 2, np.append(w, b)
    cols = [*idx, len(g) - 1]
    sse = g[y, y] - 2 * v @ g[cols, y] + v @ g[np.ix_(cols, cols)] @ v
    sst = g[y, y] - g[y, -1] ** 2 / g[-1, -1]
    return 1 - sse / sst if sst else 0.0


def rfe_ridge(df: DataFrame, cols: list[str], target: str, keep: int = 5, alpha: float = 1.0) -> DataFrame:
    g, left = gram(df, cols, target)[0], list(range(len(cols)))
    while True:
        w, _ = ridge_from_gram(g, left, alpha)
        if len(left) <= keep:
            return _ranking(df, "RFE (Ridge)", "Coefficient", [(cols[i], x) for i, x in zip(left, w)])
        left.pop(int(np.argmin(w ** 2)))


def sfs_ridge(df: DataFrame, cols: list[str], target: str, fold: str, keep: int = 5, alpha: float = 1.0) -> DataFrame:
    """Forward selection by mean cross-validated R2; the score is the one reached when added."""
    folds = gram(df, cols, target, fold)
    total = sum(folds.values())
    picked: list[int] = []
    scores: list[float] = []
    while len(picked) < min(keep, len(cols)):
        def value(c):
            idx = [*picked, c]
            return float(np.mean([r2_from_gram(g, idx, *ridge_from_gram(total - g, idx, alpha)) for g in folds.values()]))
        tried = {c: value(c) for c in range(len(cols)) if c not in picked}
        best = max(tried, key=lambda c: round(tried[c], TIE_PLACES))
        picked.append(best)
        scores.append(tried[best])
    return _ranking(df, "SFS (Ridge)", "R2", [(cols[c], s) for c, s in zip(picked, scores)])


def sfs_knn(df: DataFrame, cols: list[str], target: str, key: str, fold: str, folds: int = 5, keep: int = 5, k: int = 5) -> DataFrame:
    """Forward selection with a k-nearest-neighbour regressor; all candidates and folds of a step are
    searched in one job, over distinct points: what is searched does not grow with the number of equal rows."""
    picked: list[str] = []
    scores: list[float] = []
    base = df.select(F.col(key).alias("_key"), F.col(target).cast("double").alias("_y"), F.col(fold).cast("int").alias("_fold"),
                     *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    while len(picked) < min(keep, len(cols)):
        trial = [c for c in cols if c not in picked]
        shape = F.explode(F.array(*[F.struct(F.lit(i).alias("cand"), *[F.col(c).alias(f"x{n}") for n, c in enumerate([*picked, c0])])
                                    for i, c0 in enumerate(trial)]))
        long = base.select("_key", "_y", "_fold", shape.alias("s")).select("_key", "_y", "_fold", "s.*")
        feats = [f"x{n}" for n in range(len(picked) + 1)]
        query = long.withColumnRenamed("_fold", "f")
        # of a point's rows in a fold only the smallest k keys can be neighbours
        order = Window.partitionBy("cand", "_fold", *feats).orderBy("_key")
        first = long.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k)
        train = first.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).filter(F.col("f") != F.col("_fold"))
        points = nearest_of_points(train, query, "_key", feats, k, by=["cand", "f"])
        near = cut_lineage(points.select("cand", "f", *feats, F.explode("near.id").alias("_key")))
        guess = near.join(base.select("_key", "_y"), "_key").groupBy("cand", "f", *feats).agg(F.avg("_y").alias("_g"))
        # rows of one point and fold share their guess: their squares are those around their mean and those of its distance to the guess
        own = query.groupBy("cand", "f", *feats).agg(F.count("_y").alias("_n"), F.avg("_y").alias("_mean"), (F.var_pop("_y") * F.count("_y")).alias("_around"))
        lost = own.join(guess, ["cand", "f", *feats]).groupBy("cand", "f").agg(F.sum(F.col("_around") + F.col("_n") * (F.col("_mean") - F.col("_g")) ** 2).alias("_sse"))
        known = reduce(lambda a, b: a & b, [F.abs(c) < float("inf") for c in feats])
        spread = query.filter(known).groupBy("cand", "f").agg((F.var_pop("_y") * F.count("_y")).alias("_sst"))
        error = lost.join(spread, ["cand", "f"]).select("cand", "f", (1 - F.try_divide("_sse", "_sst")).alias("r2"))
        best = error.groupBy("cand").agg(F.avg("r2").alias("r2")).orderBy(F.round("r2", TIE_PLACES).desc_nulls_last(), "cand").first()
        picked.append(trial[best["cand"]])
        scores.append(best["r2"])
    return _ranking(df, "SFS (KNN)", "R2", list(zip(picked, scores)))


# -- reports ------------------------------------------------------------------------------------
def selection_table(ranking: DataFrame, level: str, dataset: str, k: int = 20) -> DataFrame:
    """Top ``k`` features of a ranking with the run's level and dataset."""
    top = ranking.orderBy(F.abs("score").desc_nulls_last(), "feature").limit(k)
    return top.select(F.lit(level).alias("level"), F.lit(dataset).alias("dataset"), "*")


def compare_selections(a: DataFrame, b: DataFrame, k: int = 20) -> DataFrame:
    """Outer join of two (feature, score) tables, missing scores 0, best averages first."""
    both = a.select("feature", F.col("score").alias("score_a")).join(b.select("feature", F.col("score").alias("score_b")), "feature", "full_outer")
    both = both.fillna(0.0, subset=["score_a", "score_b"])
    return both.withColumn("avg_score", (F.col("score_a") + F.col("score_b")) / 2).orderBy(F.col("avg_score").desc(), "feature").limit(k)


def rank_attribution(importance: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` features whose permutation moves the prediction most."""
    return importance.orderBy(F.abs("score").desc(), "feature").limit(k)
