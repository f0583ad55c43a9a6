"""Missing-value profiles, dominance and correlation. Wide tables are measured in one pass."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from carefold.operators.columns import null_shares


def is_missing(df: DataFrame, c: str) -> Column:
    """Null, or the empty string in a text column."""
    col = F.col(c)
    return col.isNull() | (col == "") if dict(df.dtypes)[c] == "string" else col.isNull()


def _row_missing(df: DataFrame, cols: list[str]) -> Column:
    flags = F.array(*[is_missing(df, c).cast("int") for c in cols])
    return F.aggregate(flags, F.lit(0), lambda acc, x: acc + x)


def nulls_per_column(df: DataFrame) -> DataFrame:
    """(column, n_missing, n_rows) from a single aggregate over the whole table."""
    rows = [F.struct(F.lit(c).alias("column"), F.count_if(is_missing(df, c)).alias("n_missing"),
                     F.count("*").alias("n_rows")) for c in df.columns]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def nulls_per_group(df: DataFrame, key: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(*[F.count_if(is_missing(df, c)).alias(f"{c}_missing") for c in cols])
    total = F.aggregate(F.array(*[F.col(f"{c}_missing") for c in cols]), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.withColumn("total_missing", total)


def row_null_histogram(df: DataFrame, key: str) -> DataFrame:
    cols = [c for c in df.columns if c != key]
    return df.select(_row_missing(df, cols).alias("num_missing")).groupBy("num_missing").agg(F.count("*").alias("n"))


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count, percentage and decile per column."""
    pct = F.coalesce(F.try_divide(F.col("n_missing") * F.lit(100.0), F.col("n_rows")), F.lit(0.0))
    return nulls_per_column(df).select(
        "column", "n_missing", pct.alias("missing_percent"),
        (F.round(pct / F.lit(10.0)) * F.lit(10)).cast("int").alias("missing_group"))


def missing_profile_where(df: DataFrame, pred: Column) -> DataFrame:
    return missing_profile(df.filter(pred))


def completeness_buckets(df: DataFrame) -> DataFrame:
    pct = F.round(F.coalesce(F.try_divide(F.col("n_missing") * F.lit(100.0), F.col("n_rows")), F.lit(0.0)), 1)
    label = (F.when(pct == 0, "Complete (0%)").when(pct <= 10, "0-10%").when(pct <= 50, "10-50%")
             .when(pct <= 95, "50-95%").otherwise(">95%"))
    return nulls_per_column(df).select(label.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n_columns"))


def null_matrix(df: DataFrame, cols: list[str], n: int = 200, key: str | None = None) -> DataFrame:
    """0 / 1 missing indicators of the first ``n`` rows in the order of ``key``, as shown in a heat map."""
    return (df.orderBy(key) if key else df).limit(n).select(*[F.col(c).isNull().cast("int").alias(c) for c in cols])


def same_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whether the same rows are missing in all the columns."""
    differ = F.lit(False)
    for c in cols[1:]:
        differ = differ | (F.col(cols[0]).isNull() != F.col(c).isNull())
    return df.agg((F.count_if(differ) == 0).cast("int").alias("same"))


def dominant_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Share of the most frequent value among the non-null values of every column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])
    counted = (df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
               .groupBy("column", "v").agg(F.count("*").alias("_n")))
    return counted.groupBy("column").agg((F.max("_n") / F.sum("_n")).alias("share"))


def dominant_numeric(df: DataFrame, cols: list[str], t: float) -> list[str]:
    """Numeric columns whose most frequent value reaches share ``t`` (t > 0.5), or that are empty.

    A value held by more than half of the rows is the median, so one quantile pass names the only
    candidate of each column and a second pass counts it exactly; no value is shuffled."""
    if not cols:
        return []
    if t <= 0.5:
        raise ValueError("the median rule needs a threshold above one half")
    mid = df.agg(*[F.percentile_approx(c, 0.5, 10000).alias(c) for c in cols]).first()
    tested = [c for c in cols if mid[c] is not None]
    if not tested:
        return list(cols)
    hits = df.agg(*[F.avg((F.col(c) == F.lit(mid[c])).cast("double")).alias(c) for c in tested]).first()
    return [c for c in cols if mid[c] is None or hits[c] >= t]


def _correlation(x: Column, y: Column) -> Column:
    """Pearson r over rows where both are present; null when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    vx, vy = F.var_pop(F.when(both, x)), F.var_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy))


def _number(c: str) -> Column:
    """The column as double, NaN as null."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, r) for every pair i < j in the order of ``cols``, pairwise complete; NaN counts as missing.

    Blocks of moments, centred on the column means, come from matrix products per partition and are summed by pair."""
    typed = [_number(c).alias(c) for c in cols]
    centre_row = df.agg(*[F.avg(_number(c)).alias(c) for c in cols]).first()
    centre = np.array([0.0 if centre_row[c] is None else centre_row[c] for c in cols])
    names = list(cols)
    upper = np.triu_indices(len(names), 1)

    def moments(batches):
        total = None
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - centre
            m = ~np.isnan(x)
            x = np.where(m, x, 0.0)
            m = m.astype(float)
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            block = total[:, upper[0], upper[1]]
            yield pd.DataFrame({"pi": upper[0], "pj": upper[1],
                                **{k: block[p] for p, k in enumerate(["n", "sx", "sy", "sxx", "syy", "sxy"])}})

    schema = "pi int, pj int, n double, sx double, sy double, sxx double, syy double, sxy double"
    sums = df.select(*typed).mapInPandas(moments, schema).groupBy("pi", "pj").agg(
        *[F.sum(k).alias(k) for k in ["n", "sx", "sy", "sxx", "syy", "sxy"]])
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    tiny = F.lit(1e-12)
    flat = (vx <= tiny * F.col("sxx")) | (vy <= tiny * F.col("syy"))
    r = F.when(~flat, F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))
    label = F.array(*[F.lit(c) for c in names])
    return sums.select(F.get(label, F.col("pi")).alias("i"), F.get(label, F.col("pj")).alias("j"), r.alias("r"))


def high_corr_pairs(df: DataFrame, cols: list[str], t: float = 0.95) -> DataFrame:
    return corr_matrix(df, cols).filter(F.abs("r") >= t)


def target_corr(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(feature, r) against the target from one aggregate."""
    y = _number(target)
    rows = [F.struct(F.lit(c).alias("feature"), _correlation(_number(c), y).alias("r")) for c in cols]
    return df.agg(F.array(*rows).alias("m")).select(F.inline("m"))


