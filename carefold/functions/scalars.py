"""Scalar column functions. All stay native so that they run inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.functions import constants as C


def parse_date(col: Column, fmt: str = "ddMMMyyyy") -> Column:
    return F.try_to_date(col, fmt)


def date_parts(col: Column) -> tuple[Column, Column, Column]:
    """Year, month and weekday with Monday as 0."""
    return F.year(col), F.month(col), F.weekday(col)


def days_between(end: Column, start: Column) -> Column:
    return F.datediff(end, start)


def age_years(on: Column, born: Column) -> Column:
    return (F.datediff(on, born) / F.lit(365)).cast("int")


def decode(col: Column, mapping: dict) -> Column:
    """Code -> label; an unmatched code gives null."""
    chain = None
    for key, label in mapping.items():
        chain = F.when(col == key, label) if chain is None else chain.when(col == key, label)
    return chain


def readmitted(resume: Column, assessed: Column, days: int = 30, compat: bool = False) -> Column:
    """1 when care resumed within ``days`` of the assessment. ``compat`` also accepts a resumption
    that lies before the assessment."""
    gap = F.datediff(resume, assessed)
    hit = gap < days if compat else (gap >= 0) & (gap < days)
    return F.when(hit, 1).otherwise(0)


def bmi_ceil(lb: Column, inch: Column) -> Column:
    """Rounded-up integer BMI; 0 when it cannot be computed."""
    ratio = F.try_divide(lb, inch * inch) * F.lit(C.BMI_FACTOR_CEIL)
    return F.coalesce(F.ceil(ratio).cast("int"), F.lit(0))


def bmi(lb: Column, inch: Column, lo: float = 5.0, hi: float = 250.0) -> Column:
    return plausible(F.try_divide(lb * F.lit(C.BMI_FACTOR), inch * inch), lo, hi)


def plausible(col: Column, lo: float, hi: float) -> Column:
    """Null outside ``[lo, hi]``."""
    return F.when(col.between(lo, hi), col)


def bmi_category(value: Column) -> Column:
    chain = None
    for lo, hi, label in C.BMI_CLASSES:
        test = value < hi if lo is None else (value >= lo) & (value < hi)
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain.otherwise(C.BMI_REST)


def age_group(age: Column, edges: list[int] | None = None) -> Column:
    """Left-closed interval label such as ``[18, 35)``; null outside the edges."""
    edges = edges or C.AGE_EDGES
    chain = None
    for lo, hi in zip(edges, edges[1:]):
        test, label = (age >= lo) & (age < hi), f"[{lo}, {hi})"
        chain = F.when(test, label) if chain is None else chain.when(test, label)
    return chain


def missing_decile(pct: Column) -> Column:
    return (F.round(pct / F.lit(10.0)) * F.lit(10)).cast("int")


def clean_numeric(col: Column, sentinels: list[str]) -> Column:
    """Sentinel text -> null, everything else to a number where it is one."""
    return F.when(~col.isin(sentinels), col.try_cast("double"))


def inf_to_null(col: Column) -> Column:
    return F.when(~col.isin(float("inf"), float("-inf")), col)


def flag_and_fill(df: DataFrame, cols: list[str], flag: str, fill: int = 0) -> DataFrame:
    """Add ``flag`` = 1 where the first column is missing, then fill all of them."""
    return df.withColumn(flag, F.col(cols[0]).isNull().cast("int")).fillna(fill, subset=cols)


def fill_const(df: DataFrame, value, subset: list[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=subset)


def zip5(col: Column) -> Column:
    """Five-digit ZIP from ZIP or ZIP+4; anything that is not all digits gives null."""
    head = F.substring_index(F.trim(col), "-", 1)
    return F.when(head.rlike("^[0-9]{1,9}$"), F.lpad(F.substring(head, 1, 5), 5, "0"))


def title_case(col: Column) -> Column:
    return F.initcap(col)


def split_trim(col: Column, sep: str = ",") -> Column:
    parts = F.transform(F.split(col, sep), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def urban_rural(urb: Column, rur: Column) -> Column:
    return F.when(rur >= urb, "Rural").otherwise("Urban")


def classify(prob: Column, t: float | Column) -> Column:
    return (prob >= t).cast("int")


def encode_gender(col: Column) -> Column:
    return F.coalesce(col == "Female", F.lit(False)).cast("int")


def pretty_indicator(col: Column) -> Column:
    out = F.replace(col, F.lit("ACS_PCT"), F.lit("%"))
    out = F.replace(out, F.lit("ACS_TOT"), F.lit("TOTAL"))
    return F.replace(out, F.lit("_"), F.lit(" "))


def episode_id(bene: Column, start: Column) -> Column:
    """``id_date``; null when the id is null, and a missing date is written as ``nan``."""
    return F.concat(bene.cast("string"), F.lit("_"), F.coalesce(start.cast("string"), F.lit("nan")))


def count_map_rows(col: Column) -> Column:
    """Dict-like text (single or double quotes) -> map of counts; bad text gives null."""
    return F.from_json(F.translate(col, "'", '"'), "map<string,bigint>")


def truthy(col: Column) -> Column:
    """A flag is set when it is a number other than zero; text is parsed first."""
    return F.coalesce(col.try_cast("double") != 0, F.lit(False))


def hash_bucket(key: Column, buckets: int | None = None, salt: str = "") -> Column:
    """Reproducible 32-bit hash of a key from its md5, optionally reduced to ``buckets``."""
    text = F.concat(key.cast("string"), F.lit(salt)) if salt else key.cast("string")
    value = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return value if buckets is None else value % buckets
