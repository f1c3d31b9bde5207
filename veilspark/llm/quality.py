"""Quality classifier: hashed word and character n-gram embeddings, averaged for each document,
with a softmax output, trained by stochastic gradient descent in numpy.

Training reads at most SAMPLE labelled documents (those whose xxhash64 of doc_id comes first
among the labelled rows that may be learned from); all documents are scored, over their whole
text.  Features: each word, hashed to the first half of the buckets, and each run of 3 and of 4
characters inside a text, hashed to the second half; a word equal to the one before it (a word bigram
of that kind) has a bucket of its own.  Case and symbols stay, since shouting and symbol
junk show there.  A text's vector is the mean of its features' vectors; as the output has two
classes, a bucket's vector counts only through its product with the difference of the two output
rows, so scoring gathers one number for each feature and takes the mean.

Defined cases: null or empty text has no features and gets the score of the output bias alone;
rows with null quality or null doc_id are not learned from; several labels of one document count
each, and of rows that repeat its doc_id the first text is learned from; without labels of both classes the score is the smoothed share of label 1 for every text;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, flat_bytes, read, remainder, slices

SAMPLE = 2000
BUCKETS = 1 << 14  # of words, and as many of n-grams
DIM = 10
GRAMS = (3, 4)
#: Two halves, and one bucket for a word that repeats the word before it.
TOTAL = 2 * BUCKETS + 1
THRESHOLD = 0.3
#: Bytes of text whose features are made at once.
PART = 1 << 18
#: The table's step is so many times the output's: a feature's gradient is its small share of the document.
TABLE_RATE = 32.0


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 rows (its bytes, one after the other), and the rows' offsets in them."""
    lead = (raw & 0xC0) != 0x80
    starts = np.flatnonzero(lead)
    before = np.concatenate(([0], np.cumsum(lead)))
    size = np.diff(np.append(starts, len(raw)))
    code = raw[starts].astype(np.uint32)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        code[more] = (code[more] << np.uint32(8)) | raw[starts[more] + j]
    return code, before[off]


def gram_features(code: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of n characters inside a row, and the row of each."""
    size = len(code) - n + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        key = np.full(size, n * 40503, dtype=np.uint32)
        for i in range(n):
            key = (key ^ code[i : i + size]) * np.uint32(2654435761)
            key ^= key >> np.uint32(15)
        key *= np.uint32(2246822519)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    good = row[:size] == row[n - 1 : n - 1 + size]
    bucket = BUCKETS + (key >> np.uint32(18)).astype(np.int64)
    return bucket[good], row[:size][good]


def parts(column):
    """First row and rows of each part of a text column: about PART bytes, one row at least.  It bounds
    what a worker holds beside its batch by the longest text, not by the batch."""
    for a, b in slices(flat_bytes(column)[1], PART):
        yield a, column.slice(a, b - a)


def features(column):
    """(bucket, row) of all features of a text column, in parts."""
    w = Words(column)
    for a, b in slices(w.first, 1 << 17):
        yield (w.hash[w.first[a] : w.first[b]] & np.uint64(BUCKETS - 1)).astype(np.int64), np.repeat(np.arange(a, b), np.diff(w.first[a : b + 1]))
    row = np.repeat(np.arange(len(w.off) - 1), w.counts())
    again = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])) + 1
    yield np.full(len(again), TOTAL - 1, dtype=np.int64), row[again]
    for a, b in slices(w.off, PART):
        code, at = characters(w.raw[w.off[a] : w.off[b]], w.off[a : b + 1] - w.off[a])
        for n in GRAMS:
            # a part of more than PART characters is one row, so the cuts fall at the same places of it in any batch
            for c in range(0, max(len(code) - n + 1, 0), PART):
                bucket, row = gram_features(code[c : c + PART + n - 1], np.clip(at - c, 0, min(PART + n - 1, len(code) - c)), n)
                yield bucket, row + a


def _bags(batches):
    for batch in batches:
        n = batch.num_rows
        step = 8
        for a in range(0, n, step):
            part = batch.slice(a, step)
            m = part.num_rows
            seen = np.zeros((m, TOTAL), dtype=np.int32)
            for bucket, row in features(part.column("text")):
                seen += np.bincount(row * TOTAL + bucket, minlength=m * TOTAL).reshape(m, -1).astype(np.int32)
            idx = [np.flatnonzero(x) for x in seen]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int32()), pa.array([i.astype(np.int32) for i in idx], pa.list_(pa.int32())), pa.array([seen[k][i] for k, i in enumerate(idx)], pa.list_(pa.int32()))],
                names=["doc_id", "quality", "bucket", "n"],
            )


class Model:
    """weight: for each bucket, its share in the log-odds; bias: the log-odds of an empty text."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float32), float(bias)

    def score(self, column) -> np.ndarray:
        total, count = np.zeros(len(column)), np.zeros(len(column))
        for first, part in parts(column):
            rows = slice(first, first + len(part))
            for bucket, row in features(part):
                total[rows] += np.bincount(row, weights=self.weight[bucket], minlength=len(part))
                count[rows] += np.bincount(row, minlength=len(part))
        z = np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)
        return 1 / (1 + np.exp(-z))


def train(bags: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 2.0, seed: int = 7) -> Model:
    """bags: (label, buckets, counts) of each document.  Plain SGD, one document at a time."""
    ones = sum(label for label, *_ in bags)
    if ones in (0, len(bags)):
        share = (ones + 1) / (len(bags) + 2)
        return Model(np.zeros(TOTAL), np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (TOTAL, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            label, idx, n = bags[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = np.zeros(DIM, np.float32)
            if len(idx):
                share = (n / n.sum()).astype(np.float32)
                hidden = share @ table[idx]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the loss at the output
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            if len(idx):
                table[idx] -= lr * TABLE_RATE * share[:, None] * back
    return Model(table @ (out[1] - out[0]), bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """Learns from labelled documents outside fold 0.  The sample, and what of each of its documents
    reaches the driver (bucket counts), are bounded whatever the size of the tables."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter("quality is not null and doc_id is not null").filter(remainder(folds) != 0)
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    order = F.xxhash64(F.col("doc_id"))
    chosen = known.orderBy(order, "doc_id", "quality").limit(sample).collect()
    if not chosen:
        return train([])
    picked = docs.sparkSession.createDataFrame([(r.doc_id, int(r.quality > 0)) for r in chosen], "doc_id long, quality int")
    texts = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that repeat an id, one is learned from
    bags = texts.join(F.broadcast(picked), "doc_id").select("doc_id", "text", "quality").mapInArrow(_bags, "doc_id long, quality int, bucket array<int>, n array<int>").toArrow()
    rows = zip(bags["doc_id"].to_pylist(), bags["quality"].to_pylist(), bags["bucket"], bags["n"], strict=True)
    rows = [(d, q, np.asarray(b.values), np.asarray(n.values)) for d, q, b, n in rows]
    rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes()))
    return train([r[1:] for r in rows])


def score_documents(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: a number for each bucket

    def run(batches):
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(m.score(batch.column("text")), pa.float64())], names=["doc_id", "held_out", "score"]
            )

    held = (remainder(folds) == 0).alias("held_out")
    scored = docs.select("doc_id", held, "text").mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, read(spark, sf_dir, "labels")))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, that score at least THRESHOLD."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column("text")) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
