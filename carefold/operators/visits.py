"""Visit history. Visits are first reduced to one row per key and day, so the ordered step only sees
distinct days (bounded by the calendar) even when one patient holds a large part of the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _same(a: DataFrame, b: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])


def _days(df: DataFrame, keys: list[str], date: str, id: str) -> DataFrame:
    daily = df.groupBy(*keys, date).agg(F.count(id).alias("_n"), F.min(id).alias("_first"))
    order = W.partitionBy(*keys).orderBy(date)
    return daily.select(*keys, date, "_first", F.sum("_n").over(order).alias("_visits"), F.lag(date).over(order).alias("_before"))


def _attach(df: DataFrame, days: DataFrame, keys: list[str], date: str) -> DataFrame:
    out = df.join(days, _same(df, days, [*keys, date]), "left")
    for c in [*keys, date]:
        out = out.drop(days[c])
    return out


def _previous(date: str, id: str) -> Column:
    """The day before in the history, or the same day for all but the first visit of a day."""
    return F.when(F.col(id).eqNullSafe(F.col("_first")), F.col("_before")).otherwise(F.col(date))


def visit_number(df: DataFrame, keys: list[str], date: str, id: str) -> DataFrame:
    """Visits up to and including the day; visits of one day share the value."""
    return _attach(df, _days(df, keys, date, id), keys, date).withColumn("num_visits", F.col("_visits")).drop(
        "_visits", "_first", "_before")


def previous_visit(df: DataFrame, keys: list[str], date: str, id: str) -> DataFrame:
    """Date of the previous visit in (date, id) order; ``id`` is unique inside a day."""
    return _attach(df, _days(df, keys, date, id), keys, date).withColumn("prev_visit_date", _previous(date, id)).drop(
        "_visits", "_first", "_before")


def visit_history(df: DataFrame, keys: list[str], date: str, id: str) -> DataFrame:
    """Visit number, previous visit date and gap in days from one pass."""
    return (_attach(df, _days(df, keys, date, id), keys, date)
            .withColumn("num_visits", F.col("_visits"))
            .withColumn("prev_visit_date", _previous(date, id))
            .withColumn("days_between_visits", F.datediff(date, F.col("prev_visit_date")))
            .drop("_visits", "_first", "_before"))


def visit_gap(df: DataFrame, keys: list[str], date: str, id: str) -> DataFrame:
    return visit_history(df, keys, date, id).drop("num_visits", "prev_visit_date")


def visit_gap_same_day(df: DataFrame, key: str, date: str, id: str) -> DataFrame:
    """The same-day variant: the history of one patient and one day, so the number is the day's
    total and the gap is 0, or null for the day's first visit."""
    daily = df.groupBy(key, date).agg(F.count(id).alias("num_visits"), F.min(id).alias("_first"))
    out = df.join(daily, _same(df, daily, [key, date]), "left").drop(daily[key]).drop(daily[date])
    return out.withColumn("days_between_visits", F.when(~F.col(id).eqNullSafe(F.col("_first")), F.lit(0))).drop("_first")


def days_cared_for(df: DataFrame, key: str, date: str, start: str) -> DataFrame:
    last = df.groupBy(key).agg(F.max(date).alias("last_date"))
    return df.join(last, key, "left").withColumn("days_cared_for", F.datediff("last_date", start))


def one_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key in the stated order. A minimum over (order, row) combines map-side, so a
    hot key never meets in one sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    pick = F.min(F.struct(*order, *rest)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)
