"""Diagnosis codes: chapters, condition flags, label sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions import constants as C
from carefold.functions.codes import chapter_set, has_dx, in_span, in_span_by_digits, join_labels


def row_chapters(df: DataFrame, cols: list[str]) -> DataFrame:
    """All chapters of a row: sorted range and title arrays plus their text form."""
    codes = [F.col(c) for c in cols]
    ranges, titles = chapter_set(codes), chapter_set(codes, titles=True)
    return (df.withColumns({"icd_ranges": ranges, "icd_titles": titles})
            .withColumns({"icd_range_text": join_labels(F.col("icd_ranges")),
                          "icd_title_text": join_labels(F.col("icd_titles"))}))


def chapter_counts(df: DataFrame, id: str, cols: list[str], distinct_rows: bool = True) -> DataFrame:
    """22 columns: how many of the patient's distinct chapter sets contain the chapter."""
    sets = df.select(id, chapter_set([F.col(c) for c in cols]).alias("_set"))
    sets = sets.distinct() if distinct_rows else sets
    return sets.groupBy(id).agg(*[
        F.count_if(F.array_contains("_set", span)).alias(span) for span, _ in C.ICD_CHAPTERS])


def condition_flags(df: DataFrame, cols: list[str], compat: bool = False, clinical: bool = False) -> DataFrame:
    """Chronic-condition flags over the code columns. Default: three-character prefix inside the
    condition's chapters. ``clinical`` uses the narrower clinical prefixes where there are any;
    ``compat`` reproduces the all-digits comparison."""
    test = in_span_by_digits if compat else in_span

    def flag(name: str) -> Column:
        if clinical and name in C.CONDITION_PREFIXES:
            return has_dx([F.col(c) for c in cols], C.CONDITION_PREFIXES[name])
        hits = [F.coalesce(test(F.col(c), s), F.lit(False)) for c in cols for s in C.CONDITION_CHAPTERS[name]]
        return reduce(lambda a, b: a | b, hits).cast("int")

    return df.withColumns({n: flag(n) for n in C.CONDITION_CHAPTERS})


def dx_flags(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({n: has_dx([F.col(c) for c in cols], p) for n, p in C.DX_PREFIXES.items()})


def bipartite_edges(df: DataFrame, id: str, arr: str) -> DataFrame:
    """Distinct (patient, chapter) edges."""
    return df.select(id, F.explode(arr).alias("label")).distinct()
