"""Sorting, set operations and reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def sort_by(df: DataFrame, cols: list[str], ascending=True) -> DataFrame:
    return df.orderBy(*cols, ascending=ascending)


def top_k(df: DataFrame, col: str, k: int, largest: bool = True, tie: list[str] | None = None) -> DataFrame:
    first = F.col(col).desc_nulls_last() if largest else F.col(col).asc_nulls_last()
    return df.orderBy(first, *(tie or [])).limit(k)


def stack(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def drop_duplicates(df: DataFrame) -> DataFrame:
    return df.distinct()


def key_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def melt(df: DataFrame, ids: list[str], values: list[str], var: str, value: str) -> DataFrame:
    """Long form; rows with a null value are kept."""
    return df.unpivot(ids, values, var, value)


def explode_list(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.explode(col))


def transpose_row(df: DataFrame, var: str = "column", value: str = "value") -> DataFrame:
    """One-row aggregate -> one row per column."""
    return df.unpivot([], df.columns, var, value)


def add_blocks(df: DataFrame, *blocks: list[Column]) -> DataFrame:
    """Encoded column blocks next to the table, in one projection."""
    return df.select("*", *[c for block in blocks for c in block])
