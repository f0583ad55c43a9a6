"""Readers. Schemas are given, never inferred, so a file is scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

FEATURE_COLLECTION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("features", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("properties", T.StructType([
            T.StructField("NAME", T.StringType()), T.StructField("STATE", T.StringType())])),
        T.StructField("geometry", T.StringType()),
    ]))),
])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, **options) -> DataFrame:
    return spark.read.schema(schema).options(header=True, **options).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_sections(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of a folder per chapter. ``schema`` names the leading columns of the files; the folder gives ``section``, as text."""
    return spark.read.schema(f"{schema}, section string").options(header=True, enforceSchema=True).csv(path)


def read_feature_collection(spark: SparkSession, path: str, state: str | None = None, multi_line: bool = True) -> DataFrame:
    """One row per county of GeoJSON feature collections: id, name, state, geometry as text.

    ``multi_line`` reads one pretty-printed document per file; without it every line is a collection
    of its own, which lets Spark split large files."""
    df = spark.read.schema(FEATURE_COLLECTION).option("multiLine", multi_line).json(path)
    rows = df.select(F.explode("features").alias("f")).select(
        F.col("f.properties.NAME").alias("county"), F.col("f.id").alias("fips"),
        F.col("f.properties.STATE").alias("state"), F.col("f.geometry").alias("geometry"))
    return rows.filter(F.col("state") == state) if state is not None else rows


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    """(topic, indicator) rows from a catalogue whose list column is written as quoted text."""
    df = spark.read.schema("idx int, topic string, names string").options(header=True, escape='"').csv(path)
    return topic_rows(df, "topic", "names")


def topic_rows(df: DataFrame, topic: str, names: str) -> DataFrame:
    found = F.regexp_extract_all(F.col(names), F.lit("'([^']+)'"), F.lit(1))
    return df.select(F.col(topic).alias("topic"), F.posexplode(found).alias("pos", "indicator"))


def read_rename_map(spark: SparkSession, path: str) -> dict[str, str]:
    """(code, name) file of a questionnaire version -> rename map for ``rename_by_map``."""
    return {r["code"]: r["name"] for r in spark.read.schema("code string, name string").csv(path, header=True).collect()}


def summarise_files(spark: SparkSession, path: str, schema: T.StructType | str, id: str) -> DataFrame:
    """Rows, columns and distinct patients per file (or partition folder) in one read of the folder."""
    df = read_csv(spark, path, schema, recursiveFileLookup=True)
    names = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return df.withColumn("_file", names).groupBy(F.col("_file").alias("file_name")).agg(
        F.count("*").alias("num_rows"), F.lit(len(df.columns)).alias("num_columns"),
        F.countDistinct(id).alias("num_patients"))
