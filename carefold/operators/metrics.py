"""Classifier evaluation as aggregates over (label, prediction, probability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions import constants as C
from carefold.operators import ordered


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Counts per (label, prediction) and the share of the label's row in percent."""
    counts = df.groupBy(label, pred).agg(F.count("*").alias("n"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("_t"))
    return counts.join(totals, label).select(label, pred, "n", (F.col("n") * F.lit(100.0) / F.col("_t")).alias("row_percent"))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def class_report(df: DataFrame, label: str = "label", pred: str = "prediction", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; a class counts when it is a label or a prediction."""
    by = list(by or [])
    counts = df.groupBy(*by, label, pred).agg(F.count("*").alias("_n"))
    sides = counts.select(*by, "_n", F.inline(F.array(
        F.struct(F.col(label).alias("class"), F.lit(1).alias("_is_label"), (F.col(label) == F.col(pred)).cast("int").alias("_hit")),
        F.struct(F.col(pred).alias("class"), F.lit(0).alias("_is_label"), F.lit(0).alias("_hit")))))
    sums = sides.groupBy(*by, "class").agg(
        F.sum(F.col("_n") * F.col("_hit")).alias("tp"),
        F.sum(F.when(F.col("_is_label") == 1, F.col("_n")).otherwise(0)).alias("support"),
        F.sum(F.when(F.col("_is_label") == 0, F.col("_n")).otherwise(0)).alias("_predicted"))
    p, r = F.try_divide(F.col("tp"), F.col("_predicted")), F.try_divide(F.col("tp"), F.col("support"))
    f1 = F.try_divide(F.col("tp") * F.lit(2.0), F.col("support") + F.col("_predicted"))
    return sums.select(*by, "class", _zero(p).alias("precision"), _zero(r).alias("recall"), _zero(f1).alias("f1"), "support")


def report_averages(report: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Macro and support-weighted averages of a class report."""
    macro = [F.avg(c).alias(f"macro_{c}") for c in ["precision", "recall", "f1"]]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ["precision", "recall", "f1"]]
    return report.groupBy(*(by or [])).agg(*macro, *weighted, F.sum("support").alias("support"))


def report_summary(report: DataFrame, positive=1) -> DataFrame:
    """One row of a class report: macro F1, and precision and recall of the positive class (null if no row has or gets it)."""
    own = {c: F.max(F.when(F.col("class") == positive, F.col(c))) for c in ["precision", "recall"]}
    return report.agg(F.avg("f1").alias("macro_f1"), *[own[c].alias(c) for c in own])


def accuracy(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def score_counts(df: DataFrame, label: str = "label", prob: str = "probability", by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score."""
    return df.groupBy(*(by or []), prob).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _ranked(df: DataFrame, label: str, prob: str, by: list[str] | None) -> DataFrame:
    """Distinct scores with the true and false positives (``tp``, ``fp``) of a cut at each of them."""
    return ordered.running_totals(score_counts(df, label, prob, by), prob, {"tp": "pos", "fp": "neg"}, by, descending=True)


def curve_measures(df: DataFrame, label: str = "label", prob: str = "probability", by: list[str] | None = None) -> DataFrame:
    """``roc_auc`` (rank-sum area, tied scores count half) and ``average_precision`` (step sum of precision over recall, ties
    taken together) from one ranking of the scores; null where a class has no row."""
    lost = F.sum(F.col("pos") * (F.col("fp") - F.col("neg") / F.lit(2.0)))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return _ranked(df, label, prob, by).groupBy(*(by or [])).agg(
        (1 - F.try_divide(lost, pairs)).alias("roc_auc"), F.try_divide(steps, F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str = "label", prob: str = "probability", by: list[str] | None = None) -> DataFrame:
    return curve_measures(df, label, prob, by).drop("average_precision")


def average_precision(df: DataFrame, label: str = "label", prob: str = "probability", by: list[str] | None = None) -> DataFrame:
    return curve_measures(df, label, prob, by).drop("roc_auc")


def one_vs_rest(df: DataFrame, classes: dict, label: str = "label") -> DataFrame:
    """Long form (class, is_class, probability); ``classes`` maps a class to its probability column."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(label) == c).cast("int").alias("is_class"),
                              F.col(p).alias("probability")) for c, p in classes.items()])
    return df.select(F.inline(rows))


def ovr_curves(df: DataFrame, classes: dict, label: str = "label") -> DataFrame:
    """ROC-AUC and average precision of every class against the rest."""
    return curve_measures(one_vs_rest(df, classes, label), "is_class", "probability", ["class"])


def curve_points(df: DataFrame, label: str = "label", prob: str = "probability") -> DataFrame:
    """ROC and precision / recall points at every distinct threshold."""
    cum = _ranked(df, label, prob, None)
    # one scalar for both totals, so the scores are counted a second time only once
    totals = score_counts(df, label, prob).agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return cum.withColumn("_all", totals).select(
        F.col(prob).alias("threshold"), "tp", "fp", F.try_divide(F.col("tp"), F.col("_all.p")).alias("tpr"),
        F.try_divide(F.col("fp"), F.col("_all.n")).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def compare_models(df: DataFrame, model: str = "model", label: str = "label", pred: str = "prediction") -> DataFrame:
    """Macro F1 per model, best first."""
    avg = report_averages(class_report(df, label, pred, [model]), [model])
    return avg.select(model, "macro_f1", "weighted_f1").orderBy(F.col("macro_f1").desc(), model)


def split_rates(df: DataFrame, split: str, label: str) -> DataFrame:
    counts = df.groupBy(split, label).agg(F.count("*").alias("n"))
    totals = counts.groupBy(split).agg(F.sum("n").alias("_t"))
    return counts.join(totals, split).select(split, label, "n", (F.col("n") / F.col("_t")).alias("share"))


def threshold_table(df: DataFrame, label: str = "label", prob: str = "probability") -> DataFrame:
    """Macro F1 at the 16 thresholds 0.10, 0.15, ... 0.85.

    A row is only placed between two thresholds (one aggregate); the confusion counts of every
    threshold follow from those 17 cells."""
    cell = sum(((F.col(prob) >= F.lit(t / 100.0)).cast("int") for t in C.THRESHOLD_PERCENTS), F.lit(0))
    cells = df.groupBy(cell.alias("_cell")).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    spread = cells.select("*", F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("_need"), F.lit(t / 100.0).alias("threshold")) for i, t in enumerate(C.THRESHOLD_PERCENTS)])).alias("t"))
    over = F.col("_cell") >= F.col("t._need")
    agg = spread.groupBy("t.threshold").agg(
        F.sum(F.when(over, F.col("_p")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("_n")).otherwise(0)).alias("fp"),
        F.sum(F.when(over, 0).otherwise(F.col("_p"))).alias("fn"), F.sum(F.when(over, 0).otherwise(F.col("_n"))).alias("tn"))
    f_pos = _zero(F.try_divide(F.col("tp") * F.lit(2.0), F.col("tp") * 2 + F.col("fp") + F.col("fn")))
    f_neg = _zero(F.try_divide(F.col("tn") * F.lit(2.0), F.col("tn") * 2 + F.col("fp") + F.col("fn")))
    return agg.select("threshold", "tp", "fp", "fn", "tn", ((f_pos + f_neg) / F.lit(2.0)).alias("macro_f1"))


def find_threshold(df: DataFrame, label: str = "label", prob: str = "probability") -> float:
    """Threshold with the best macro F1, the lowest on a tie; 0.5 when none scores above zero."""
    best = threshold_table(df, label, prob).orderBy(F.col("macro_f1").desc(), "threshold").first()
    return best["threshold"] if best and best["macro_f1"] > 0 else 0.5
