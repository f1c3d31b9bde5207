"""Exact duplicates by a log-structured merge index, with DataFrame operations alone.

Memtable and flush: each task sorts the digests of the rows it reads and writes them as a run, with
no shuffle; a flush of a table leaves one sorted run for each task (one file), all of tier 0.
Compaction: FAN_IN flushes of a tier, or all that are left at the end, are merged by digest range
into one run of the next tier.  Of entries with one digest the best identifier stays and the sizes
add up, so compaction changes no answer.

Filter: a compacted run carries a filter over the digests that stand in it more than once, in
bitmaps of 4 KB.  It has 16 bits for each such digest but FILTER_BITS in all, so what is broadcast
never exceeds FILTER_BITS / 8 bytes; beyond that the filter only turns fewer rows away.

Lookup: each row finds its entry by a join on the digest, in which large groups are met by broadcast
(common.join_groups).  Byte verification: texts that the filter lets through meet the other
texts of their digest, equal ones folded before they move, and the smallest must equal the largest.
Digests for which this fails (collisions; none are known) are grouped again by the whole text, so
the result is exact in any case.

Defined cases: null text counts as empty, and all empty texts form one group; among equal texts
the row with the most code points in the original text stays, then the one with the smallest
doc_id (null last); rows repeating one doc_id count each, and share that doc_id's fate; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, join_groups, materialise, read

FAN_IN = 8
FILTER_BITS = 1 << 27
#: Bits of one bitmap, as bitmap_construct_agg makes it.
BITMAP = 1 << 15


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def digest(norm):
    """SHA-256 of the normalised text; never null, so that joins add no second evaluation for a null check."""
    return F.coalesce(F.unhex(F.sha2(norm, 256)), F.lit(b""))


def _rank(doc_id, n_chars):
    """Smaller is better: longest original, then smallest doc_id, null last."""
    return F.struct((-n_chars).alias("less"), doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"))


def entries(docs: DataFrame) -> DataFrame:
    """An entry for each row: a run's columns digest, best, size."""
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return docs.select(digest(normalised()).alias("digest"), _rank(F.col("doc_id"), n).alias("best"), F.lit(1).cast("long").alias("size"))


def flush(docs: DataFrame) -> DataFrame:
    """Runs of tier 0: what each task reads, sorted by digest, in a file of its own."""
    return materialise(entries(docs).sortWithinPartitions("digest"), "digest-flush")


def compact(*runs: DataFrame) -> DataFrame:
    """One run from many, by digest: the best entry, and the number of rows."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    folded = merged.groupBy("digest").agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    return materialise(folded.sortWithinPartitions("digest"), "digest-run")


class MergeIndex:
    """Runs by tier; see the module's docstring."""

    def __init__(self, fan_in: int = FAN_IN):
        self.fan_in, self.tiers = fan_in, [[]]

    def add(self, docs: DataFrame) -> DataFrame:
        """Flushes docs and merges the tiers that are full; the flushed entries, one for each row."""
        run = flush(docs)
        self.tiers[0].append(run)
        tier = 0
        while len(self.tiers[tier]) >= self.fan_in:
            if tier + 1 == len(self.tiers):
                self.tiers.append([])
            self.tiers[tier + 1].append(compact(*self.tiers[tier]))
            self.tiers[tier] = []
            tier += 1
        return run

    def run(self) -> DataFrame:
        """All tiers merged into one run, which becomes the last tier."""
        parts = [run for tier in self.tiers for run in tier]
        if len(parts) > 1 or self.tiers[0]:
            self.tiers = [[], [compact(*parts)]]
        return self.tiers[-1][0]


def repeats_filter(run: DataFrame, repeated: int, most_bits: int = FILTER_BITS) -> tuple[int, DataFrame]:
    """The number of bits, and the bitmaps (bucket, bits) over the digests of more than one row."""
    n = BITMAP
    while n < min(16 * repeated, most_bits):
        n *= 2
    place = F.xxhash64("digest").bitwiseAND(n - 1)
    marks = run.filter("size > 1").select(F.shiftright(place, 15).alias("bucket"), place.bitwiseAND(BITMAP - 1).alias("bit"))
    return n, materialise(marks.groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")), "digest-filter")


def probe(rows: DataFrame, n: int, bitmaps: DataFrame) -> DataFrame:
    """The rows whose digest may be one of the filter's; bitmaps hold n bits at most, which bounds the broadcast."""
    place = F.xxhash64("digest").bitwiseAND(n - 1)
    rows = rows.withColumn("bucket", F.shiftright(place, 15)).withColumn("bit", place.bitwiseAND(BITMAP - 1))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("long")
    met = rows.join(F.broadcast(bitmaps), "bucket").withColumn("byte", byte).filter(F.expr("bit_get(byte, cast(bit % 8 as int)) = 1"))
    return met.drop("bucket", "bit", "bits", "byte")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = docs.select("doc_id", "text")
    index = MergeIndex()
    flushed = index.add(docs)
    run = index.run()
    total, repeated = run.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.when(F.col("size") > 1, 1))).first()
    groups = run.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"))
    found = join_groups(flushed.select(F.col("best.doc_id").alias("doc_id"), "digest"), groups, ["digest"], "group_size", total)
    columns = ["doc_id", "digest", "keep_id", "group_size"]
    texts = docs.select(normalised().alias("norm")).withColumn("digest", digest(F.col("norm")))
    hits = probe(texts, *repeats_filter(run, repeated))
    same = hits.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    collided = materialise(same.filter("least != most").select("digest"), "digest-collisions")
    if not collided.isEmpty():
        found = found.join(collided, "digest", "left_anti").select(*columns).unionByName(_by_text(docs, collided).select(*columns))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _by_text(docs: DataFrame, collided: DataFrame) -> DataFrame:
    """The rows whose digest is among the collided ones, grouped by the whole text."""
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    rows = docs.select("doc_id", n.alias("n"), normalised().alias("norm")).withColumn("digest", digest(F.col("norm"))).join(collided, "digest")
    groups = rows.groupBy("digest", "norm").agg(F.min(_rank(F.col("doc_id"), F.col("n"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups.select("digest", "norm", F.col("best.doc_id").alias("keep_id"), "group_size"), ["digest", "norm"])


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, doc_id AS keep_id, group_size FROM (
    SELECT text_sha256, doc_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS rn FROM d)
  WHERE rn = 1)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""
