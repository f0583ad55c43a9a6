"""Aggregations. Grouped results rely on map-side partial aggregation; nothing collects a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from carefold.operators import ordered
from carefold.operators.joins import attach_groups


def last_date(df: DataFrame, key: str, date: str) -> DataFrame:
    return df.groupBy(key).agg(F.max(date).alias("last_date"))


def n_unique(df: DataFrame, col: str, by: list[str] | None = None, approx: bool = False) -> DataFrame:
    fn = F.approx_count_distinct if approx else F.countDistinct
    return df.groupBy(*(by or [])).agg(fn(col).alias("n_unique"))


def value_counts(df: DataFrame, col: str, normalize: bool = False) -> DataFrame:
    out = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    if not normalize:
        return out
    total = df.agg(F.count(col).alias("t")).scalar()
    return out.withColumn("share", F.try_divide(F.col("n"), total))


def count_where(df: DataFrame, by: list[str], preds: dict[str, Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(p).alias(n) for n, p in preds.items()])


def mean_by(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def first_by(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """One value of a column that is constant inside the group (the smallest, so it repeats)."""
    return df.groupBy(*by).agg(*[F.min(c).alias(c) for c in cols])


def sum_by(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols])


def count_map(df: DataFrame, by: list[str], col: str, name: str = "counts") -> DataFrame:
    """Value counts as one map per group, built from pre-counted values."""
    counted = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n"))
    entries = F.array_sort(F.collect_list(F.struct(F.col(col).alias("key"), F.col("_n").alias("value"))))
    return counted.groupBy(*by).agg(F.map_from_entries(entries).alias(name))


def _value_pairs(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Counts ``_n`` per group, column name ``_c`` and non-null value ``_v``, counted before grouping."""
    pairs = F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("string").alias("_v")) for c in cols])
    long = df.select(*by, F.inline(pairs)).filter(F.col("_v").isNotNull())
    return long.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n"))


def count_maps(df: DataFrame, by: list[str], cols: list[str], suffix: str = "_counts") -> DataFrame:
    """``count_map`` of several columns from one pass over the table."""
    counted = _value_pairs(df, by, cols)
    entry = F.struct(F.col("_v").alias("key"), F.col("_n").alias("value"))
    return counted.groupBy(*by).agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_c") == c, entry)))).alias(c + suffix) for c in cols])


def map_rows(df: DataFrame, keep: list[str], name: str) -> DataFrame:
    return df.select(*keep, F.explode(name).alias("category", "n"))


def label_union(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Sorted union of the labels of a group; labels are made distinct before they meet."""
    distinct = df.select(*by, F.explode(col).alias("_label")).distinct()
    return distinct.groupBy(*by).agg(F.array_sort(F.collect_set("_label")).alias("labels"))


def names_by_bucket(df: DataFrame, bucket: str, name: str) -> DataFrame:
    return df.groupBy(bucket).agg(F.array_sort(F.collect_list(name)).alias("names"), F.count(name).alias("n"))


def crosstab_rate(df: DataFrame, by: str, outcome: str, levels: list[str], positive: str, min_rows: int) -> DataFrame:
    counts = [F.count_if(F.col(outcome) == v).alias(v) for v in levels]
    out = df.groupBy(by).agg(*counts, F.count("*").alias("total"))
    return out.filter(F.col("total") > min_rows).withColumn(
        "rate", F.try_divide(F.col(positive) * F.lit(100.0), F.col("total")))


def code_by_outcome(long: DataFrame, code: str, outcome: str, id: str) -> DataFrame:
    """Distinct patients per code and outcome (0 / 1). The distinct step is its own aggregate, so a
    frequent code is spread over many tasks before it is counted."""
    seen = long.filter(F.col(code).isNotNull()).select(code, outcome, id).distinct()
    out = seen.groupBy(code).agg(F.count_if((F.col(outcome) == 0) & F.col(id).isNotNull()).alias("n_0"),
                                 F.count_if((F.col(outcome) == 1) & F.col(id).isNotNull()).alias("n_1"))
    return out.withColumn("total", F.col("n_0") + F.col("n_1"))


def prefix_stats(long: DataFrame, prefix: str, outcome: str, id: str) -> DataFrame:
    return long.filter(F.col(prefix).isNotNull()).groupBy(prefix).agg(
        F.countDistinct(id).alias("n_patients"),
        F.count_if(F.col(outcome) == 0).alias("rows_0"),
        F.count_if(F.col(outcome) == 1).alias("rows_1"),
    ).withColumn("rows_total", F.col("rows_0") + F.col("rows_1"))


def codes_per_chapter(codes: DataFrame, code: str, chapter: str) -> DataFrame:
    return codes.select(code, chapter).distinct().groupBy(chapter).agg(F.count(code).alias("n_codes"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, standard deviation, minimum and maximum: one row per column, one pass."""
    def stats(c):
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                        F.stddev(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    return df.agg(F.array(*[stats(c) for c in cols]).alias("s")).select(F.inline("s"))


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """``describe`` plus the exact quartiles of every column."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])))
    quart = ordered.quantiles(long, "value", [0.25, 0.5, 0.75], ["column"])
    return describe(df, cols).join(quart.toDF("column", "p25", "p50", "p75"), "column", "left")


def box_summary(df: DataFrame, by: str, col: str) -> DataFrame:
    """Exact quartiles and mean of a column per group."""
    quart = ordered.quantiles(df, col, [0.25, 0.5, 0.75], [by]).toDF(by, "q1", "median", "q3")
    means = df.groupBy(by).agg(F.avg(col).alias("mean"), F.count(col).alias("n"))
    return means.join(quart, by)


def histogram(df: DataFrame, col: str, by: str, bins: int = 50) -> DataFrame:
    """Density histogram per class over the class's own range, left-closed bins, last bin closed."""
    edges = df.filter(F.col(col).isNotNull()).groupBy(by).agg(
        F.min(col).alias("_lo"), F.max(col).alias("_hi"), F.count(col).alias("_total"))
    values = df.filter(F.col(col).isNotNull()).groupBy(by, col).agg(F.count("*").alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    raw = F.floor(F.try_divide(F.col(col) - F.col("_lo"), width))
    bin_no = F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int")
    ranged = attach_groups(values, edges.filter(F.col(by).isNotNull()), [by]).filter(F.col("_total").isNotNull())
    return (ranged.withColumn("bin", bin_no).withColumn("_width", width)
            .groupBy(by, "bin").agg(F.sum("_n").alias("n"), F.min("_total").alias("_t"), F.min("_width").alias("_w"))
            .select(by, "bin", "n", F.try_divide(F.col("n"), F.col("_t") * F.col("_w")).alias("density")))


def flag_overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"),
                  F.count_if(b & ~a).alias("only_b"), F.count_if(a).alias("all_a"))


def patients_by_filled(df: DataFrame, filled: Column, id: str) -> DataFrame:
    return df.select(filled.alias("n_filled"), id).groupBy("n_filled").agg(F.countDistinct(id).alias("n_patients"))


def mode_by(df: DataFrame, by: list[str], col: str, default: str = "UNKNOWN") -> DataFrame:
    """Most frequent value per group; ties go to the smallest, a group without values gets the
    default. Counting happens before the group is formed, so memory does not grow with the group."""
    counted = df.groupBy(*by, col).agg(F.count(col).alias("_n"))
    best = F.min(F.when(F.col(col).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(col).alias("v"))))
    return counted.groupBy(*by).agg(best.alias("_b")).select(*by, F.coalesce(F.col("_b.v"), F.lit(default)).alias("mode"))


def modes_by(df: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Modes of several text columns per group in one pass; null where a group has no value."""
    counted = _value_pairs(df, by, cols)
    key = F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))
    return counted.groupBy(*by).agg(*[F.min(F.when(F.col("_c") == c, key)).getField("v").alias(c) for c in cols])


def rate_by_flag(df: DataFrame, flags: list[str], target: str) -> DataFrame:
    """Target rate inside every flag, and overall."""
    rows = [F.struct(F.lit(f).alias("flag"), F.avg(F.when(F.col(f) == 1, F.col(target))).alias("rate")) for f in flags]
    rows.append(F.struct(F.lit("overall").alias("flag"), F.avg(target).alias("rate")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def sum_category_counts(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    return df.select(*(by or []), F.explode(col).alias("category", "_n")).groupBy(*(by or []), "category").agg(
        F.sum("_n").alias("n"))


def range_counts(df: DataFrame, arr: str) -> DataFrame:
    return df.select(F.explode(arr).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def cooccurrence(pairs: DataFrame, min_weight: int = 2) -> DataFrame:
    """Weighted undirected edges from (a, b) pairs."""
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= min_weight)


def pivot_first(df: DataFrame, key: str, col: str, levels: list[str], value: str, fill=None) -> DataFrame:
    """Pivot over known levels with conditional aggregates."""
    out = df.groupBy(key).agg(*[F.min(F.when(F.col(col) == v, F.col(value))).alias(v) for v in levels])
    return out if fill is None else out.fillna(fill, subset=levels)


def total_of(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols])
