"""Projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions import constants as C
from carefold.functions.scalars import truthy


def rename_by_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename in one projection; names that are absent are ignored."""
    return df.withColumnsRenamed(mapping)


def drop_present(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def columns_like(df: DataFrame, prefix=(), suffix=(), contains=(), ignore_case: bool = False) -> list[str]:
    """Names matching any prefix, suffix or substring, in table order."""
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    low = (lambda s: s.lower()) if ignore_case else (lambda s: s)
    pre, suf, mid = (as_list(x) for x in (prefix, suffix, contains))
    return [c for c in df.columns
            if any(low(c).startswith(low(p)) for p in pre) or any(low(c).endswith(low(s)) for s in suf)
            or any(low(m) in low(c) for m in mid)]


def split_feature_groups(df: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(social-determinant columns, all other columns); ``keep`` names stay in both."""
    keep = keep or []
    social = [c for c in columns_like(df, prefix=C.SDOH_PREFIXES) if c not in keep]
    return df.select(*keep, *social), df.drop(*social)


def select_types(df: DataFrame, types: list[str]) -> DataFrame:
    return df.select(*[f.name for f in df.schema if f.dataType.simpleString() in types])


def numeric_columns(df: DataFrame, but: list[str] | None = None) -> list[str]:
    kinds = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    return [n for n, t in df.dtypes if (t in kinds or t.startswith("decimal")) and n not in (but or [])]


def bool_to_int(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(n).cast("int").alias(n) if t == "boolean" else F.col(n) for n, t in df.dtypes])


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def expand_struct(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != name], f"{name}.*")


def count_filled(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in cols])


def unique_names(df: DataFrame) -> DataFrame:
    """Keep the first of several columns that share a name."""
    fields, names = [], set()
    for i, n in enumerate(df.columns):
        if n not in names:
            names.add(n)
            fields.append(i)
    if len(fields) == len(df.columns):
        return df
    unique = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in fields])


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def cohort(df: DataFrame, cond: str) -> DataFrame:
    return df.filter(F.col(cond) == 1)


def cohort_all(df: DataFrame, conds: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) == 1 for c in conds]))


def cohort_any(df: DataFrame, conds: list[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 1, F.lit(False)) for c in conds]))


def null_shares(df: DataFrame) -> dict[str, float]:
    """Null share per column from one aggregate; one short row reaches the driver."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns]).first()
    n = row["_rows"]
    return {c: (n - row[c]) / n if n else 0.0 for c in df.columns}


def drop_sparse_columns(df: DataFrame, t: float, decimals: int | None = None) -> DataFrame:
    """Drop columns whose null share exceeds ``t``. With ``decimals`` the percentage is rounded
    first, as the 99 % rule does with one decimal."""
    share = null_shares(df)

    def sparse(s: float) -> bool:
        return round(s * 100, decimals) > t * 100 if decimals is not None else s > t

    return df.drop(*[c for c, s in share.items() if sparse(s)])


def any_filled(cols: list[str]) -> Column:
    """True when any flag of the group is a non-zero number."""
    return reduce(lambda a, b: a | b, [truthy(F.col(c)) for c in cols])


def groups_above(df: DataFrame, by: list[str], k: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") > k)


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys on each side, shared keys, and rows of ``a`` that will find a partner."""
    left = a.groupBy(key).agg(F.count("*").alias("_rows"))
    right = b.select(key).distinct().withColumn("_right", F.lit(1))
    return (left.filter(F.col(key).isNotNull()).withColumn("_left", F.lit(1))
            .join(right.filter(F.col(key).isNotNull()), key, "full_outer")
            .agg(F.count("_left").alias("left_keys"), F.count("_right").alias("right_keys"),
                 F.count(F.col("_left") + F.col("_right")).alias("shared_keys"),
                 F.coalesce(F.sum(F.when(F.col("_right") == 1, F.col("_rows"))), F.lit(0)).alias("matching_rows")))
