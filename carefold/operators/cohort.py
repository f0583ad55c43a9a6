"""Outcomes, targets and one-row-per-episode selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carefold.operators.columns import any_filled, drop_present


def outcome_class(ed: list[str], hospital: list[str]) -> Column:
    """Any hospital reason: Hospitalized; else any emergency reason: ED Only; else Stable."""
    return F.when(any_filled(hospital), "Hospitalized").when(any_filled(ed), "ED Only").otherwise("Stable")


def ed_target(df: DataFrame, ed: list[str], hospital: list[str], name: str = "target") -> DataFrame:
    """Emergency presenters only; 1 when also admitted."""
    return df.filter(any_filled(ed)).withColumn(name, any_filled(hospital).cast("int"))


def episode_label(df: DataFrame, episode: list[str], coded: Column, positive: Column, order: list[str],
                  name: str = "target", also: dict[str, Column] | None = None) -> DataFrame:
    """First coded row per episode with a label taken from *all* rows of the episode; ``also`` adds
    further any-row flags.

    Everything comes out of one aggregate over the episode, so the table is shuffled once."""
    labels = {name: positive, **(also or {})}
    rest = [c for c in df.columns if c not in episode and c not in order]
    row = F.struct(*order, *rest)
    out = df.groupBy(*episode).agg(F.min(F.when(coded, row)).alias("_row"),
                                   *[F.max(F.coalesce(p, F.lit(False)).cast("int")).alias(n) for n, p in labels.items()])
    return out.filter(F.col("_row").isNotNull()).select(*episode, "_row.*", *labels)


def episode_first(df: DataFrame, episode: list[str], order: list[str], cols: list[str] | None = None) -> DataFrame:
    """First non-null value of every column in the stated order; episodes with a null key are dropped."""
    cols = cols or [c for c in df.columns if c not in episode and c not in order]
    keyed = df.dropna(subset=episode)
    picks = [F.min(F.when(F.col(c).isNotNull(), F.struct(*order, c))).getField(c).alias(c) for c in cols]
    firsts = [F.min(F.struct(*order)).getField(o).alias(o) for o in order]
    return keyed.groupBy(*episode).agg(*firsts, *picks)


def fill_absent(df: DataFrame, cols: list[str]) -> DataFrame:
    """A clinical finding that is not recorded is absent."""
    return df.fillna(0, subset=cols)


def month_and_drop(df: DataFrame, date: str, dates: list[str], name: str = "Assessment_Month") -> DataFrame:
    return drop_present(df.withColumn(name, F.month(date)), dates)
