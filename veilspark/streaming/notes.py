"""Detection and sanitizing on a folder that notes keep arriving in.

The per-document operators hold no state, so they run on a stream as they stand; an id comes from
the file's name, since a rank would change with every new file.  Counts by type go by windows of
arrival, with a watermark that lets old windows close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import deidentify as D


def stream_notes(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """id, filename, text, arrived of every *.txt file, old and new."""
    raw = spark.readStream.option("pathGlobFilter", "*.txt").option("maxFilesPerTrigger", files_per_trigger).text(folder, wholetext=True)
    return raw.select(
        F.xxhash64("_metadata.file_name").alias("id"), F.col("_metadata.file_name").alias("filename"), F.regexp_replace("value", "\r\n?", "\n").alias("text"), F.col("_metadata.file_modification_time").alias("arrived")
    )


def sanitize_stream(notes: DataFrame, method: str, **options) -> DataFrame:
    found = D.detect(notes, **options)
    return D.sanitize(found, method).withColumn("num_entities", F.size("entities"))


def type_counts(notes: DataFrame, window: str = "1 hour", late: str = "1 day", **options) -> DataFrame:
    """window, type, n: spans found, by window of arrival; arrivals later than the watermark are left out."""
    spans = D.explode_spans(D.detect(notes.withWatermark("arrived", late), **options), "arrived")
    return spans.groupBy(F.window("arrived", window), "type").agg(F.count(F.lit(1)).alias("n"))


def run_to_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to parquet with exactly-once bookkeeping in checkpoint; once: what is there now, then ends."""
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
