"""Encoding, scaling and imputation. Codebooks and fitted values are small per-column results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.operators import ordered
from carefold.operators.aggregates import modes_by
from carefold.operators.joins import attach_counted, attach_groups
from carefold.session import cut_lineage


#: Levels of a column up to which it may be spread over columns.
MAX_LEVELS = 10_000


def levels_of(df: DataFrame, cols: list[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct values per column. Every level becomes a column, so callers choose columns by ``split_by_cardinality``
    or pass the levels.

    Levels are estimated first, in buffers of fixed size; a column clearly above ``limit`` (over 5/4 of it, the estimate
    being off by 5 %) is an error, so what is collected is bounded."""
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    wide = {c: row[c] for c in cols if row[c] * 4 > limit * 5}
    if wide:
        raise ValueError(f"more than {limit} levels, use binary_encode: {wide}")
    row = df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols]).first()
    return {c: list(row[c]) for c in cols}


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = False, levels: dict[str, list] | None = None) -> DataFrame:
    """0 / 1 column per level, named ``column_level``; null gives all zeros."""
    levels = levels or levels_of(df, cols)
    made = [F.coalesce(F.col(c) == v, F.lit(False)).cast("int").alias(f"{c}_{v}")
            for c in cols for v in levels[c][1 if drop_first else 0:]]
    return df.select(*[c for c in df.columns if c not in cols], *made)


def codebook(df: DataFrame, col: str) -> DataFrame:
    """Value -> ordinal from 1 in sorted order."""
    return ordered.dense_ordinal(df, col, "ordinal")


def codebooks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, ordinal) rows of several columns of one type: the distinct values of every column, numbered from 1 in
    sorted order. All columns are read, made distinct and numbered together, whatever their number."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in cols])).alias("p")
    distinct = df.select(pairs).select("p.*").filter("value IS NOT NULL").distinct().withColumn("_one", F.lit(1))
    numbered = ordered.running_totals(distinct, "value", {"ordinal": "_one"}, ["column"])
    return numbered.select("column", "value", F.col("ordinal").cast("bigint").alias("ordinal"))


def _with_ordinals(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, str], dict[str, int]]:
    """``df`` with the ordinal of every column's value, the names of those columns, and the number of values per column.

    The codebooks of all columns of a type are one table, written once; a column's part of it is sent to every executor up to a
    counted size, and joined with salt beyond it."""
    types = dict(df.dtypes)
    out, names, sizes = df, {}, dict.fromkeys(cols, 0)
    for kind in dict.fromkeys(types[c] for c in cols):
        same = [c for c in cols if types[c] == kind]
        book = cut_lineage(codebooks(df, same))
        sizes |= {r["column"]: r["n"] for r in book.groupBy("column").agg(F.max("ordinal").alias("n")).collect()}
        for c in same:
            names[c] = f"_ordinal_{len(names)}"
            own = book.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("ordinal").alias(names[c]))
            out = attach_counted(out, own, [c], sizes[c])
    return out, names, sizes


def binary_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Ordinal bits, most significant first, named ``column_0, column_1, ...``; null gives zeros."""
    out, names, sizes = _with_ordinals(df, cols)
    bits = []
    for c in cols:
        width = max(1, int(sizes[c]).bit_length())
        ordinal = F.coalesce(F.col(names[c]), F.lit(0).cast("bigint"))
        bits += [F.getbit(ordinal, F.lit(width - 1 - b)).cast("int").alias(f"{c}_{b}") for b in range(width)]
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in cols], *bits)


def split_by_cardinality(df: DataFrame, cols: list[str], limit: int = 55) -> tuple[list[str], list[str]]:
    """(high, low) cardinality columns."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > limit], [c for c in cols if row[c] <= limit]


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text -> position in sorted order from 0; null stays null."""
    out, names, _ = _with_ordinals(df, cols)
    return out.select(*[(F.col(names[c]) - 1).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])


def fit_scale(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column scales by 1."""
    row = train.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m_{i}"] or 0.0, row[f"s_{i}"] or 1.0) for i, c in enumerate(cols)}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    made = {c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items()}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def standard_scale(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Scale train and the other tables with the values fitted on train."""
    fitted = fit_scale(train, cols)
    return [apply_scale(d, fitted) for d in [train, *others]]


def impute_mean(df: DataFrame, num: list[str], text: list[str]) -> DataFrame:
    row = df.agg(*[F.avg(c).alias(c) for c in num]).first() if num else {}
    means = {c: row[c] for c in num if row[c] is not None}
    out = df.select(*[F.col(c).cast("double").alias(c) if c in means else F.col(c) for c in df.columns])
    out = out.fillna(means) if means else out
    return out.fillna("", subset=text) if text else out


def impute_mode(df: DataFrame, cols: list[str], patient: str, groups: list[str], default: str = "UNKNOWN") -> DataFrame:
    """Fill from the patient's mode, then from the mode of the group, then with the default."""
    own = modes_by(df, [patient], cols).withColumnsRenamed({c: f"_own_{c}" for c in cols})
    grp = modes_by(df, groups, cols).withColumnsRenamed({c: f"_grp_{c}" for c in cols})
    joined = attach_groups(df.join(own, patient, "left"), grp, groups)
    filled = {c: F.coalesce(F.col(c), F.col(f"_own_{c}"), F.col(f"_grp_{c}"), F.lit(default)) for c in cols}
    return joined.select(*[filled[c].alias(c) if c in cols else F.col(c) for c in df.columns])


def first_argmax(cols: list[str]) -> Column:
    """Index of the largest non-null value, the first one on a tie; null when all are null."""
    best = F.greatest(*cols)
    chain = F.when(F.col(cols[0]) == best, 0)
    for i, c in enumerate(cols[1:], 1):
        chain = chain.when(F.col(c) == best, i)
    return chain


def impute_race(df: DataFrame, race_cols: list[str], county: str, age_group: str, gender: str,
                any_gap: bool = False) -> DataFrame:
    """Fill missing race flags with the most probable race: county mean times (age group, gender)
    mean, largest product first. Rows are filled when all flags are missing (``any_gap``: when any
    is). Rows without a usable prior stay as they are."""
    first = df.filter(F.col(county).isNotNull()).groupBy(county).agg(*[F.avg(c).alias(f"_c{i}") for i, c in enumerate(race_cols)])
    second = df.filter(F.col(age_group).isNotNull() & F.col(gender).isNotNull()).groupBy(age_group, gender).agg(
        *[F.avg(c).alias(f"_g{i}") for i, c in enumerate(race_cols)])
    joined = attach_groups(attach_groups(df, first, [county]), second, [age_group, gender])
    scored = joined.withColumns({f"_p{i}": F.col(f"_c{i}") * F.col(f"_g{i}") for i in range(len(race_cols))})
    scored = scored.withColumn("_best", first_argmax([f"_p{i}" for i in range(len(race_cols))]))
    gaps = [F.col(c).isNull() for c in race_cols]
    need = gaps[0]
    for g in gaps[1:]:
        need = need | g if any_gap else need & g
    filled = {c: F.when(need & F.col("_best").isNotNull(), (F.col("_best") == i).cast("double"))
              .otherwise(F.col(c).cast("double")) for i, c in enumerate(race_cols)}
    return scored.select(*[filled[c].alias(c) if c in race_cols else F.col(c) for c in df.columns])
