"""Corpus cleaning and packing over ``documents``: toxic rows go, one row of each near-duplicate group stays, rows with
benchmark passages go, live secrets are blotted out, and what is left is packed into training sequences.

Every stage takes (spark, docs, sf_dir), works on all its predecessor kept and is written as Parquet in between. All but the
last return the columns of ``documents``, and further columns of any name as they are; ``n_chars`` follows the text where a stage
changes it. An empty table gives an empty result at every stage. Repeated rows: one of them stays from the second stage on.

The near-duplicate stage departs from its dealt method: the Gray-order index only connects close copies early, pairs at a
similarity of 0.8 come from a prefix filter, which loses none."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from carefold.llm import decontaminate, neardup, packing, secrets, toxicity
from carefold.session import cut_lineage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the labelled documents, does not reject.

    Null and empty texts stay, and so do rows with a null id. Repeated rows stay or go alike. Without labelled rows nothing goes."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id (null ids first; ties by the text's hash).

    Null, empty and blank texts are equal to each other, so one row of them stays."""
    return neardup.keep_one(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage; null and empty texts have none. Without a benchmark all rows stay."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, live secrets replaced by a mark; a null text stays null. Rows with a null source have one owner in common."""
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in the training sequences. A null or empty text is its closing id alone;
    rows with a null id are packed like others; equal lengths are ranked in any order, which changes places but no piece."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", civil), ("near duplicates", distinct), ("benchmark decontamination", unseen), ("secret scan", without_secrets), ("packing", packed)]
#: No SQL can express the model or the packing; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
