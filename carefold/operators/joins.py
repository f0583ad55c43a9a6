"""Joins. Broadcast hints go to the constant code tables (their size is fixed by the constants) and to
tables of group values that were counted first; every other side is left to the optimizer's own size check
and adaptive execution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import MapType, VariantType

from carefold.functions.codes import bare_code
from carefold.session import cut_lineage

#: Rows up to which a table of group values is sent to every executor. Beyond it the join is salted.
SMALL_GROUPS = 50_000
SALTS = 64


def with_last_date(df: DataFrame, key: str, date: str, name: str = "last_date") -> DataFrame:
    """Latest date per key on every row. The maximum is combined map-side, so a hot key costs one
    row per task, and adaptive execution splits its join partition."""
    last = df.groupBy(key).agg(F.max(date).alias(name))
    return df.join(last, key, "left")


def left_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left")


def join_sdoh(df: DataFrame, sdoh: DataFrame, key: str = "zip5") -> DataFrame:
    return df.join(sdoh, key)


def join_renamed(a: DataFrame, b: DataFrame, left_on: str, right_on: str) -> DataFrame:
    """Inner join on differently named keys; the key itself is dropped."""
    return a.join(b.withColumnRenamed(right_on, left_on), left_on).drop(left_on)


#: Joined rows that one task of ``spread_join`` makes, about.
TASK_PAIRS = 5_000_000


def spread_join(a: DataFrame, b: DataFrame, on: list[str], pairs: int = TASK_PAIRS) -> DataFrame:
    """Inner join of tables with many rows a key on both sides, so that the result is far larger than what is read.

    Tasks are dealt by the number of joined rows, which adaptive execution does not see: rows are counted by key first. Of a key with
    more than ``pairs`` joined rows the larger side is dealt by hash and the other repeated. A small result is joined as usual."""
    count = F.count("*").cast("double")
    counts = cut_lineage(a.groupBy(*on).agg(count.alias("_na")).join(b.groupBy(*on).agg(count.alias("_nb")), on))
    made = F.col("_na") * F.col("_nb")
    parts = math.ceil((counts.agg(F.sum(made)).first()[0] or 0) / pairs)
    if parts <= int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")) and counts.filter(made > pairs).isEmpty():
        return a.join(b, on)
    # a key takes as many cuts as its larger side has rows at most
    cuts = F.least(F.ceil(made / pairs), F.greatest("_na", "_nb")).cast("int")
    heavy = counts.filter(made > pairs).select(*on, *[F.when(F.col("_na") >= F.col("_nb"), x).otherwise(y).alias(n) for n, x, y in (("_ca", cuts, 1), ("_cb", 1, cuts))])
    heavy = cut_lineage(heavy)
    n = heavy.count()
    sides = []
    for df, own, other in ((a, "a", "b"), (b, "b", "a")):
        hashed = F.xxhash64(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])
        placed = attach_counted(df, heavy, on, n).withColumn(f"_s{own}", F.pmod(hashed, F.coalesce(f"_c{own}", F.lit(1))).cast("int"))
        sides.append(placed.withColumn(f"_s{other}", F.explode(F.sequence(F.lit(0), F.coalesce(f"_c{other}", F.lit(1)) - 1))).drop("_ca", "_cb"))
    keys = [*on, "_sa", "_sb"]
    left, right = (d.repartition(parts, *keys) for d in sides)
    return left.join(right, keys).drop("_sa", "_sb")


def join_county(a: DataFrame, b: DataFrame, on: list[str] | None = None) -> DataFrame:
    return spread_join(a, b, on or ["County", "Fips"])


def join_multi(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return a.join(b, on, how)


def join_suffixed(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join; names on both sides that are not keys get a suffix."""
    shared = (set(a.columns) & set(b.columns)) - set(on)
    left = a.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = b.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    return left.join(right, on, how)


def left_join_fill(a: DataFrame, b: DataFrame, on: list[str], fill=0) -> DataFrame:
    added = [c for c in b.columns if c not in on]
    return a.join(b, on, "left").fillna(fill, subset=added)


def outer_join_fill(a: DataFrame, b: DataFrame, on: list[str], fill=0) -> DataFrame:
    return a.join(b, on, "full_outer").fillna(fill).distinct()


def range_join(codes: DataFrame, ranges: DataFrame, col: Column, lo: str, hi: str) -> DataFrame:
    """Rows of ``codes`` with the ranges that hold ``col`` (left join). If ``ranges`` has a ``pos`` column, overlapping
    ranges are resolved to the first by it; the rows of ``codes`` must then be distinct.

    A range is repeated once per first letter it covers, which turns the range condition into a
    hash join on the letter with a residual check."""
    letters = F.explode(F.sequence(F.ascii(lo), F.ascii(hi)))
    keyed = ranges.withColumn("_letter", letters)
    left = codes.withColumn("_value", col).withColumn("_letter", F.ascii("_value"))
    cond = (left["_letter"] == keyed["_letter"]) & (left["_value"] >= keyed[lo]) & (left["_value"] <= keyed[hi])
    joined = left.join(keyed, cond, "left").drop(left["_letter"]).drop(keyed["_letter"]).drop("_value")
    if "pos" not in ranges.columns:
        return joined
    rest = [c for c in joined.columns if c not in ranges.columns]
    first = F.min(F.struct("pos", *[c for c in ranges.columns if c != "pos"])).alias("_first")
    return joined.groupBy(*rest).agg(first).select(*rest, "_first.*")


def matching_rows(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.join(b, on, "left_semi")


def prefix_join(codes: DataFrame, mapping: DataFrame, code: str, lengths: tuple[int, ...] = (3, 4),
                how: str = "left") -> DataFrame:
    """Codes with the conditions whose prefix they carry; one output row per code and prefix length.

    ``mapping`` is a (condition, prefix) table; the optimizer broadcasts it below the session's threshold."""
    bare = bare_code(F.col(code))
    prefixes = F.array_distinct(F.array(*[F.substring(bare, 1, n) for n in lengths]))
    exploded = codes.withColumn("prefix", F.explode_outer(prefixes))
    return exploded.join(mapping, "prefix", how).drop("prefix")


def label_pairs(df: DataFrame, arr: str) -> DataFrame:
    """Unordered pairs (a < b) of the labels of one row. The array holds the labels of a single
    row's code columns, so a row yields at most 15 code pairs or 231 chapter pairs."""
    rest = [c for c in df.columns if c != arr]
    labels = F.array_sort(F.array_distinct(F.col(arr)))
    first = df.select(*rest, labels.alias("_set")).select(*rest, "_set", F.posexplode("_set").alias("_i", "a"))
    tail = F.slice(F.col("_set"), F.col("_i") + 2, F.size("_set"))
    return first.select(*rest, "a", F.explode(tail).alias("b"))


def attach_counted(df: DataFrame, groups: DataFrame, on: list[str], rows: int, limit: int = SMALL_GROUPS, salts: int = SALTS) -> DataFrame:
    """``groups`` (one narrow row per key, ``rows`` of them) joined to the rows; rows without a group, also those with a null
    key, get nulls.

    A key may have few values and one of them most of the rows, so the rows are never shuffled by the key alone. Up to ``limit``
    groups go to every executor and the rows stay where they are; beyond it every group is repeated ``salts`` times and the
    rows of a group are dealt over its copies by their hash."""
    if rows <= limit:
        return df.join(F.broadcast(groups), on, "left")
    salt = "_salt"
    while salt in df.columns or salt in groups.columns:
        salt += "_"
    hashed = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    dealt = df.withColumn(salt, F.pmod(F.xxhash64(*hashed), F.lit(salts)).cast("int"))
    copies = groups.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, salt], "left").drop(salt)


def attach_groups(df: DataFrame, groups: DataFrame, on: list[str], limit: int = SMALL_GROUPS, salts: int = SALTS) -> DataFrame:
    """``attach_counted`` for groups of unknown number: they are written once and counted first."""
    small = cut_lineage(groups)
    return attach_counted(df, small, on, small.limit(limit + 1).count(), limit, salts)


def attach_priors(df: DataFrame, first: DataFrame, first_on: list[str], second: DataFrame,
                  second_on: list[str]) -> DataFrame:
    """Two priors on every row, each by its own group."""
    return attach_groups(attach_groups(df, first, first_on), second, second_on)


def attach_constants(agg: DataFrame, df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Bring per-key constants back after an aggregate (smallest value when they are not constant)."""
    consts = df.groupBy(key).agg(*[F.min(c).alias(c) for c in cols])
    return agg.join(consts, key, "left")
