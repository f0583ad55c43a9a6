"""Co-occurrence graph of diagnosis codes, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from carefold.operators.aggregates import cooccurrence
from carefold.operators.joins import label_pairs
from carefold.session import cut_lineage


def cooccurrence_edges(df: DataFrame, arr: str, min_weight: int = 2) -> DataFrame:
    return cooccurrence(label_pairs(df.select(arr), arr).select("a", "b"), min_weight)


def _downhill(pairs: DataFrame) -> DataFrame:
    """Every edge once, from its larger to its smaller end."""
    return pairs.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable from each node of ``edges (a, b)``.

    Alternates two star steps until every node with a smaller neighbour has no other neighbour, which makes every component
    one star around its smallest node. The large star hangs every larger neighbour of a node on the smallest one, the small star
    does so with the smaller neighbours. Whole trees move at once, so the rounds grow with the logarithm of the longest chain.
    Minima are combined before the shuffle, and the side that holds a hot node's neighbours is a plain shuffled table, which adaptive
    execution can split. Every round is written to the shared folder; its first aggregate also tells whether it is needed."""
    nodes = cut_lineage(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b"))
    stars = cut_lineage(_downhill(nodes))
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut_lineage(both.groupBy("a").agg(F.min("b").alias("_m"), F.max("b").alias("_last")).filter("_m < a"))
        if low.filter("_m < _last").isEmpty():
            break
        large = _downhill(both.filter("b > a").join(low, "a", "left").select(F.col("b").alias("a"), F.coalesce("_m", "a").alias("b")))
        small = large.join(large.groupBy("a").agg(F.min("b").alias("_m")), "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("_m").alias("b")), F.struct(F.col("b").alias("a"), F.col("_m").alias("b")))).alias("e"))
        stars = cut_lineage(_downhill(small.select("e.*")))
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    alone = nodes.filter("a = b").select(F.col("a").alias("node"))
    linked = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    alone = alone.distinct().join(linked.select("node"), "node", "left_anti")
    return linked.unionByName(alone.select("node", F.col("node").alias("component")))
