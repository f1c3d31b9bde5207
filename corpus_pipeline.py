"""A training-corpus pipeline from five operators: what each stage drops is gone for the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents.  Stages judge rows, not identifiers: rows whose doc_id is null or stands on several
rows are judged and dropped one by one like all others.  Empty tables give empty results; columns
beyond doc_id, text and source are carried along unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, exact_dedup, mixing, near_dedup, quality
from veilspark.llm.common import materialise, read

#: The mixture's sampling, the classifier and the candidate search are beyond SQL; tests use brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    # written down first: Spark then knows the size of the ids, and broadcasts them only if they are few
    gone = materialise(dropped.select(F.col("doc_id").alias("gone_id")).distinct(), "stage-gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def _drop_rows(docs: DataFrame, judge) -> DataFrame:
    """docs without the rows that judge reports; judge takes doc_id and text and returns doc_ids.

    Where doc_id tells all rows apart, it is the row key.  Else the place of each row in the order of
    doc_id (null last), then of reading, stands for it, so of equals the smallest doc_id still stays.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("doc_id is null or rows > 1").isEmpty():
        return _without(docs, judge(docs.select("doc_id", "text")))
    placed = docs.withColumn("row_place", F.monotonically_increasing_id())
    ordered = placed.orderBy(F.col("doc_id").asc_nulls_last(), "row_place").drop("row_place")
    keyed = materialise(ordered.withColumn("row_key", F.monotonically_increasing_id()), "stage-keys")
    gone = materialise(judge(keyed.select(F.col("row_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("gone_key")).distinct(), "stage-gone")
    return keyed.join(gone, keyed["row_key"] == gone["gone_key"], "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return _drop_rows(docs, lambda rows: exact_dedup.exact_dedup(rows).filter("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) one document stays."""
    return _drop_rows(docs, lambda rows: near_dedup.near_duplicates(rows, n=5, percent=80).filter("not kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return _drop_rows(docs, lambda rows: decontaminate.find_contamination(rows, read(spark, sf_dir, "benchmark")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes of each document that is left."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
