"""Readers: whole-file notes, span documents, identifier tables.

All go through Spark's own sources, so any store that Spark reads will do.  A missing input raises
InputMissing before any job starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITIES = "array<struct<text:string,type:string,start:int,end:int>>"
DETECTIONS = f"id int, entities {ENTITIES}"
ANNOTATIONS = f"doc_id int, entities {ENTITIES}"


class InputMissing(FileNotFoundError):
    """An input path holds nothing."""


def require(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
        if not found:
            raise InputMissing(path)


def _clean(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def read_notes(spark: SparkSession, folder: str, ids: str = "rank") -> DataFrame:
    """id, filename, text of every *.txt file of a folder; line ends become newlines.

    ids: "rank" numbers the files by name, as stored detections expect; the names alone pass
    through one task for that.  "hash" derives the id from the name, needs no exchange, and keeps
    its value when files are added.
    """
    require(spark, folder)
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    notes = raw.select(F.col("_metadata.file_name").alias("filename"), _clean(F.col("value")).alias("text"))
    if ids == "hash":
        return notes.select(F.xxhash64("filename").alias("id"), "filename", "text")
    if ids != "rank":
        raise ValueError(f"unknown ids {ids!r}")
    names = notes.select("filename").withColumn("id", F.row_number().over(Window.orderBy("filename")).cast("int"))
    return notes.join(names, "filename").select("id", "filename", "text")


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of {id, entities}, or JSON lines of the same."""
    require(spark, path)
    return spark.read.schema(DETECTIONS).json(path, multiLine=True)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """As read_detections, for {doc_id, entities}; the key is renamed to id."""
    require(spark, path)
    return spark.read.schema(ANNOTATIONS).json(path, multiLine=True).withColumnRenamed("doc_id", "id")


def with_seq(df: DataFrame, entities: str = "entities") -> DataFrame:
    """Stored spans in the form that the span operators work on: seq is the place in the list."""
    spans = F.transform(
        F.coalesce(entities, F.array().cast(ENTITIES)),
        lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"), i.cast("int").alias("seq")),
    )
    return df.withColumn(entities, spans)


def attach(notes: DataFrame, detections: DataFrame) -> DataFrame:
    """Notes with their stored spans; a note without any gets an empty list."""
    # lists of spans are far larger than the optimizer takes them for: never broadcast them
    return with_seq(notes.join(detections.select("id", "entities").hint("merge"), "id", "left"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; every column stays a string, so codes keep their zeros."""
    require(spark, path)
    return spark.read.csv(path, header=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the trimmed lines of a text file; blank ones stay as empty strings."""
    require(spark, path)
    return spark.read.text(path).select(F.trim("value").alias("value"))
