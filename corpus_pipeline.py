"""A corpus pipeline of five stages: language, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, neardup, packing, suffix
from weftline.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language's centroid is near go; a missing label is filled in.

    Without any labelled document there is nothing to judge by, and all stay as they are.
    """
    names = docs.columns
    model = langid.fit(docs)
    if model is None:
        return docs
    found = docs.withColumn("__found", langid.identify(model, F.col("text"))).filter("not __found.rejected")
    return found.withColumn("lang", F.coalesce("lang", "__found.lang_pred")).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity 0.8)."""
    return neardup.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 that were in an earlier place are removed; documents of which nothing is left go."""
    names = docs.columns
    return suffix.without_repeats(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: a row for each repetition that the mix takes; columns as they are."""
    return mixing.mixed_rows(docs, mixing.mix(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's length bucket and batch."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixture", mixture), ("packing", packed)]
#: Language identification and suffix sorting are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
