"""ICD-10 code expressions and the small lookup tables built from the fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from carefold.functions import constants as C


def bare_code(code: Column) -> Column:
    """Upper-case code without the dot."""
    return F.upper(F.translate(code, ".", ""))


def icd_prefix(code: Column, mode: str = "first3") -> Column:
    """First three characters, or the text before the dot."""
    return F.substring(code, 1, 3) if mode == "first3" else F.substring_index(code, ".", 1)


def icd_range(code: Column) -> Column:
    """Chapter range such as ``I00-I99``; null when the code belongs to none.

    The chapters are disjoint and sorted, so a balanced decision tree finds the last one that starts
    at or before the prefix in five comparisons; the leaf checks its end."""
    prefix = F.substring(code, 1, 3)
    spans = sorted((*span.split("-"), span) for span, _ in C.ICD_CHAPTERS)

    def tree(part):
        if len(part) == 1:
            lo, hi, span = part[0]
            return F.when((prefix >= lo) & (prefix <= hi), span)
        mid = len(part) // 2
        return F.when(prefix < part[mid][0], tree(part[:mid])).otherwise(tree(part[mid:]))

    return F.when(F.length(code) >= 3, tree(spans))


def icd_title(code: Column) -> Column:
    """Chapter title; null when the code belongs to none. Looked up by range, so asking for both
    range and title evaluates the tree once and keeps the generated method small enough to compile."""
    titles = F.create_map(*[F.lit(x) for pair in C.ICD_CHAPTERS for x in pair])
    return F.try_element_at(titles, icd_range(code))


def label_set(cols: list[Column]) -> Column:
    """Distinct, sorted, non-null values of several columns of one row."""
    return sorted_labels(F.array(*cols))


def sorted_labels(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def chapter_set(cols: list[Column], titles: bool = False) -> Column:
    """Distinct, sorted chapters of several code columns. One expression is applied to the array of
    codes instead of one copy per column, which keeps the generated code small."""
    return sorted_labels(F.transform(F.array(*cols), icd_title if titles else icd_range))


def join_labels(labels: Column, empty: str = C.UNKNOWN, sep: str = ", ") -> Column:
    return F.when(F.size(labels) > 0, F.array_join(labels, sep)).otherwise(F.lit(empty))


def starts_with_any(code: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [code.startswith(p) for p in prefixes])


def has_dx(cols: list[Column], prefixes: list[str]) -> Column:
    """1 when any of the code columns starts with any of the prefixes, else 0."""
    hits = [F.coalesce(starts_with_any(c, prefixes), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, hits).cast("int")


def contains_flag(col: Column, text: str) -> Column:
    return F.coalesce(col.contains(text), F.lit(False)).cast("int")


def in_span(code: Column, span: str) -> Column:
    """True when the three-character prefix lies inside a span such as ``E00-E89``."""
    lo, hi = span.split("-")
    return F.substring(code, 1, 3).between(lo, hi)


def in_span_by_digits(code: Column, span: str) -> Column:
    """The looser historical rule: first letter inside the span's letters and *all* digits of the
    code, read as one number, inside the span's numbers (``E11.9`` counts as 119)."""
    lo, hi = span.split("-")
    digits = F.regexp_replace(F.substring(F.trim(code), 2, 64), "[^0-9]", "").try_cast("bigint")
    letter = F.substring(F.trim(code), 1, 1)
    return letter.between(lo[0], hi[0]) & digits.between(int(lo[1:]), int(hi[1:]))


def expand_codes(text: str) -> list[str]:
    """``"G45 I60-I62"`` -> ``["G45", "I60", "I61", "I62"]``."""
    out: list[str] = []
    for item in text.split():
        if "-" not in item:
            out.append(item)
            continue
        lo, hi = item.split("-")
        width = len(lo) - 1
        out.extend(f"{lo[0]}{n:0{width}d}" for n in range(int(lo[1:]), int(hi[1:]) + 1))
    return out


def chapter_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *span.split("-"), span, title) for i, (span, title) in enumerate(C.ICD_CHAPTERS)]
    return spark.createDataFrame(rows, "pos int, lo string, hi string, code_range string, section string")


def condition_table(spark: SparkSession, codes: dict[str, str]) -> DataFrame:
    """(condition, prefix) rows of a code list; a few hundred rows by construction."""
    rows = [(name, p) for name, text in codes.items() for p in expand_codes(text)]
    return spark.createDataFrame(rows, "condition string, prefix string")


def topic_table(spark: SparkSession, topics: dict[str, list[str]] | None = None) -> DataFrame:
    rows = [(t, i) for t, names in (topics or C.TOPICS).items() for i in names]
    return spark.createDataFrame(rows, "topic string, indicator string")


CHAPTER_SCHEMA = T.StructType([T.StructField("code_range", T.StringType()), T.StructField("section", T.StringType())])
