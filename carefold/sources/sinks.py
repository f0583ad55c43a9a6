"""Writers. Results stay folders of part files; nothing is funnelled through one task by default."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from carefold.functions import constants as C


@contextmanager
def open_files(spark: SparkSession, n: int) -> Iterator[None]:
    """Partitioned writes that start inside the block keep up to ``n`` files open in a task instead of sorting its rows."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(n, int(before))))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """``single`` writes one part file, for results that are small by construction."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def csv_to_parquet(df: DataFrame, path: str) -> None:
    write_parquet(df, path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_model(model: MLWritable, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_split(df: DataFrame, split: str, path: str) -> None:
    """Persist every part of a split under its own folder, the held-out part included."""
    write_parquet(df, path, [split])


def section_rows(df: DataFrame, sections: list[str] | None = None) -> DataFrame:
    """One row per input row and chapter flag above zero, with the chapter's name in ``section``."""
    names = sections or [s for s, _ in C.ICD_CHAPTERS]
    flags = F.array(*[F.when(F.col(f"`{s}`") > 0, F.lit(s)) for s in names])
    return df.withColumn("section", F.explode(F.array_compact(flags)))


def split_by_section(df: DataFrame, path: str, sections: list[str] | None = None) -> None:
    """One folder per chapter in a single pass; empty chapters get no folder. Writing by partition
    needs no shuffle, so a chapter that holds most of the rows stays spread over the writers. A task keeps a file of every
    chapter open, so its rows need not be sorted by chapter, which would hold them all in memory."""
    with open_files(df.sparkSession, len(sections or C.ICD_CHAPTERS)):
        section_rows(df, sections).write.mode("overwrite").partitionBy("section").option("header", True).csv(path)


def section_counts(df: DataFrame, sections: list[str] | None = None) -> DataFrame:
    return section_rows(df, sections).groupBy("section").agg(F.count("*").alias("num_rows"))


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_distinct) rows."""
    row = df.agg(*[F.countDistinct(c).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "n_distinct")
