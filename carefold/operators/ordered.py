"""Exact order-based results (running totals, ranks, quantiles, n smallest) without ever sorting a
whole table, or a whole hot group, in one task.

Rows are first reduced to one row per distinct value. The value range is then cut at boundaries
taken from the values with the smallest hash (a repeatable sample), each piece is accumulated on its
own, and the per-piece totals, one per group and piece, are added back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

PIECES = 256


def _pieces(df: DataFrame) -> int:
    """Follows the session's number of shuffle partitions, which a cluster sets by the size of its data."""
    return max(PIECES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _with_piece(df: DataFrame, key: str) -> DataFrame:
    """Add ``_piece``: how many of the boundary values, distinct keys with the smallest hashes, lie at or below the key.
    Every n-th boundary is compared first, then those of that stretch, n being the root of their number."""
    pieces = _pieces(df)
    stride = max(16, math.isqrt(pieces))
    picked = df.select(key).distinct().orderBy(F.xxhash64(key), key).limit(pieces - 1)
    cuts = F.array_sort(F.collect_set(key))
    found = picked.agg(F.struct(cuts.alias("all"), F.filter(cuts, lambda x, i: i % stride == 0).alias("coarse")).alias("c")).scalar()

    def below(arr):
        return F.size(F.filter(arr, lambda b: b <= F.col(key)))

    start = (F.col("_block") - 1) * stride
    fine = F.when(F.col("_block") > 0, start + below(F.slice("_cuts", start + 1, F.lit(stride)))).otherwise(0)
    return (df.withColumn("_found", found).withColumns({"_cuts": F.col("_found.all"), "_coarse": F.col("_found.coarse")})
            .withColumn("_block", F.coalesce(below("_coarse"), F.lit(0)))
            # never null, so the join on it adds no null check that would be evaluated per input row
            .withColumn("_piece", F.coalesce(fine, F.lit(0))).drop("_found", "_cuts", "_coarse", "_block"))


def running_totals(df: DataFrame, key: str, totals: dict[str, str], by: list[str] | None = None,
                   descending: bool = False) -> DataFrame:
    """Inclusive running totals over ``key``.

    ``df`` holds one row per (by, key). ``totals`` maps output name -> column to accumulate."""
    by = list(by or [])
    cut = _with_piece(df, key)

    def order(name):
        return F.col(name).desc() if descending else F.col(name).asc()

    inside = W.partitionBy(*by, "_piece").orderBy(order(key)).rowsBetween(W.unboundedPreceding, 0)
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(order("_piece")).rowsBetween(
        W.unboundedPreceding, -1)
    heads = cut.groupBy(*by, "_piece").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in totals.items()])
    heads = heads.select(*by, "_piece",
                         *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_head_{n}") for n in totals])
    local = cut.select("*", *[F.sum(c).over(inside).alias(f"_local_{n}") for n, c in totals.items()])
    return local.join(heads, [*by, "_piece"]).select(
        *df.columns, *[(F.col(f"_local_{n}") + F.col(f"_head_{n}")).alias(n) for n in totals])


def value_counts_by(df: DataFrame, key: str, by: list[str] | None = None, name: str = "_n") -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(*(by or []), key).agg(F.count("*").alias(name))


def dense_ordinal(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Distinct values of ``key`` numbered from 1 in sorted order."""
    distinct = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return running_totals(distinct, key, {name: "_one"}).select(key, F.col(name).cast("bigint").alias(name))


def quantiles(df: DataFrame, key: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles per group: one row per group, columns ``q0, q1, ...``."""
    by = list(by or [])
    ranked = running_totals(value_counts_by(df, key, by), key, {"_cum": "_n"}, by)
    sizes = df.groupBy(*by).agg(F.count(key).alias("_size"))
    if by:
        joined = ranked.join(sizes, by)
    else:
        joined = ranked.withColumn("_size", sizes.scalar())
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_size") - 1) * F.lit(float(p))
        low = F.min(F.when(F.col("_cum") >= F.floor(pos) + 1, F.col(key)))
        high = F.min(F.when(F.col("_cum") >= F.ceil(pos) + 1, F.col(key)))
        aggs += [low.alias(f"_lo{i}"), high.alias(f"_hi{i}"), F.max(pos - F.floor(pos)).alias(f"_w{i}")]
    flat = joined.groupBy(*by).agg(*aggs)
    return flat.select(*by, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}")).alias(f"q{i}")
        for i in range(len(probs))])


def smallest(df: DataFrame, hash_col: str, tie: str, quota: Column, by: list[str] | None = None) -> DataFrame:
    """The ``quota`` rows with the smallest (hash, tie) in each group.

    ``hash_col`` is a 32-bit hash. Its upper bits give up to 65,536 cells; whole cells below the
    cut are kept by a join, and only the one cell that holds the cut is ranked."""
    by = list(by or [])
    cells = df.withColumn("_cell", F.shiftright(F.col(hash_col), 16))
    counts = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n"), F.first(quota).alias("_quota"))
    upto = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_cell").rowsBetween(W.unboundedPreceding, 0)
    counts = counts.withColumn("_cum", F.sum("_n").over(upto))
    wanted = counts.filter(F.col("_cum") - F.col("_n") < F.col("_quota")).select(
        *by, "_cell", (F.col("_quota") - (F.col("_cum") - F.col("_n"))).alias("_left"), "_n")
    joined = cells.join(wanted, [*by, "_cell"])
    whole = joined.filter(F.col("_n") <= F.col("_left"))
    ranked = joined.filter(F.col("_n") > F.col("_left")).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*by, "_cell").orderBy(hash_col, tie)))
    edge = ranked.filter(F.col("_rank") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def numbered(df: DataFrame, hash_col: str, tie: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Row numbers from 1 in (hash, tie) order, exact and spread over 65,536 hash cells."""
    by = list(by or [])
    cells = df.withColumn("_cell", F.shiftright(F.col(hash_col), 16))
    counts = cells.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = (W.partitionBy(*by) if by else W.partitionBy()).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    heads = counts.select(*by, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_head"))
    inside = W.partitionBy(*by, "_cell").orderBy(hash_col, tie)
    return (cells.withColumn("_rn", F.row_number().over(inside)).join(heads, [*by, "_cell"])
            .withColumn(name, F.col("_rn") + F.col("_head")).select(*df.columns, name))
