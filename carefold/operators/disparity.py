"""Disparity indices over a county table. Means and totals are scalar subqueries or one grouped
aggregate, never a per-row recomputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions.codes import topic_table


def one_row_per_county(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Mean of every attribute per county, for input with several rows per county."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def _absolute(df: DataFrame, col: str) -> Column:
    return F.abs(F.col(col) - df.agg(F.avg(col).alias("m")).scalar())


def absolute_index(df: DataFrame, col: str, name: str = "absolute") -> DataFrame:
    return df.withColumn(name, _absolute(df, col))


def _ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 when b is 0; null only when a or b is."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def relative_index(df: DataFrame, col: str, name: str = "relative") -> DataFrame:
    return df.withColumn(name, _ratio(_absolute(df, col), df.agg(F.avg(col).alias("m")).scalar()))


def population_weighted_index(df: DataFrame, col: str, urb: str, rur: str, name: str = "weighted") -> DataFrame:
    total = df.agg((F.sum(urb) + F.sum(rur)).alias("t")).scalar()
    return df.withColumn(name, F.try_divide(_absolute(df, col) * (F.col(urb) + F.col(rur)), total))


def attributable_share(df: DataFrame, col: str, urb: str, rur: str) -> DataFrame:
    aid = _absolute(df, col)
    total = aid * F.col(urb) + aid * F.col(rur)
    return df.withColumns({"pap_urban": _ratio(aid * F.col(urb), total), "pap_rural": _ratio(aid * F.col(rur), total)})


def disparity_table(df: DataFrame, topics: dict[str, list[str]], county: str = "county", urb: str = "POPPCT_URB",
                    rur: str = "POPPCT_RUR") -> DataFrame:
    """(county, topic, indicator, five measures) for every indicator of every topic in the table."""
    names = [i for group in topics.values() for i in group if i in df.columns]
    present = {t: [i for i in group if i in df.columns] for t, group in topics.items()}
    pairs = F.array(*[F.struct(F.lit(i).alias("indicator"), F.col(i).cast("double").alias("x")) for i in dict.fromkeys(names)])
    long = df.select(county, F.col(urb).alias("_urb"), F.col(rur).alias("_rur"), F.inline(pairs))
    means = long.groupBy("indicator").agg(F.avg("x").alias("_mean"))
    total = df.agg((F.sum(urb) + F.sum(rur)).alias("t")).scalar()
    topic = F.broadcast(topic_table(df.sparkSession, present))
    aid = F.abs(F.col("x") - F.col("_mean"))
    both = F.col("aid") * F.col("_urb") + F.col("aid") * F.col("_rur")
    return (long.join(means, "indicator").join(topic, "indicator").withColumn("aid", aid).select(
        county, "topic", "indicator", F.col("aid").alias("absolute"),
        _ratio(F.col("aid"), F.col("_mean")).alias("relative"),
        F.try_divide(F.col("aid") * (F.col("_urb") + F.col("_rur")), total).alias("weighted"),
        _ratio(F.col("aid") * F.col("_urb"), both).alias("pap_urban"),
        _ratio(F.col("aid") * F.col("_rur"), both).alias("pap_rural")))


def disparity_slice(disp: DataFrame, county: str, topic: str) -> DataFrame:
    return disp.filter((F.col("county") == county) & (F.col("topic") == topic)).select(
        "indicator", "absolute", "relative", "weighted")


def disparity_pivot(disp: DataFrame, county: str, topic: str) -> DataFrame:
    """One row per indicator with its measures, 0 where a measure is missing."""
    part = disp.filter((F.col("county") == county) & (F.col("topic") == topic))
    return part.groupBy("indicator").agg(
        *[F.coalesce(F.min(c), F.lit(0.0)).alias(c) for c in ["absolute", "relative", "weighted"]])
