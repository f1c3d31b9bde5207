"""Language-model scoring by deleted interpolation.

The model is a word bigram: P(w | v) = a * c(v, w) / c(v) + b * c(w) / N + d / (V + 1), where the
three weights depend on the bucket of c(v), the frequency of the context (powers of two).  They
are learned by expectation-maximisation on held-out counts: of the texts that may be learned from,
one tenth is set aside, the estimates of the others give each held-out bigram its three terms, and
what EM needs of all of them - how often each combination of bucket, bigram and unigram estimate
occurs, estimates rounded to an eighth of a doubling - is counted in one pass over all data.  There
are at most CONTEXTS * CELLS^2 combinations (3.3 million, 52 MB), whatever the corpus.  Scores
then use the counts of all texts that may be learned from.

Counts of words and bigrams cover the whole corpus, by one block exchange: a block asks once for
each distinct word and bigram that it holds, and its answers give it the terms of its own held-out
bigrams.

Defined cases: null or empty text is the end token alone; nothing to learn from gives N = 0, and
every token has probability 1 / (V + 1) with V = 0; a null doc_id counts as empty text in the
split; repeated rows count each; an empty table gives an empty result; other columns are never
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, FAN, REQUEST, Exchange, answers_of, blocks_of, joined, pack_documents, per_block, rows_table, unpack_arrays
from .common import Words, mix, read, remainder, settle

FOLDS = 10
BUCKET_BLOCKS = 2  # a bucket of the exchange holds the keys of about so many blocks
TUNE = 1  # the fold of the learnable texts that EM holds out
END, START = np.uint64(0x1234567890ABCDEF), np.uint64(0x0FEDCBA987654321)
CONTEXTS = 32
STEP = 8  # cells of each doubling of an estimate
CELLS = 40 * STEP
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Tokens:
    """The tokens of a block: word hashes with an end after each row, and the word before each."""

    def __init__(self, table: pa.Table):
        w = Words(table["text"], lower=True)
        self.fold = table["fold"].to_numpy()
        rows, n = len(w.off) - 1, len(w.hash)
        counts = np.diff(w.first)
        self.size = counts + 1
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.now = np.empty(n + rows, dtype=np.uint64)
        is_end = np.zeros(n + rows, dtype=bool)
        is_end[self.first[1:] - 1] = True
        self.now[~is_end] = w.hash
        self.now[is_end] = END
        self.before = np.empty(n + rows, dtype=np.uint64)
        self.before[1:] = self.now[:-1]
        self.before[self.first[:-1]] = START
        fold = np.repeat(self.fold, self.size)
        self.main = (fold != 0) & (fold != TUNE)
        self.tune = fold == TUNE
        with np.errstate(over="ignore"):
            self.pair = mix(self.now * _K1 + mix(self.before * _K2))

    def count(self, keys: np.ndarray):
        """Distinct keys, the number of each token's key, and counts in the two parts of the learnable texts."""
        names, number = np.unique(keys, return_inverse=True)
        main = np.bincount(number[self.main], minlength=len(names)).astype(np.uint32)
        tune = np.bincount(number[self.tune], minlength=len(names)).astype(np.uint32)
        return names, number, main, tune


def _cell(x: np.ndarray) -> np.ndarray:
    """0 for 0, else the place of x, at most 1, on a scale of STEP to each halving."""
    out = np.zeros(len(x), dtype=np.int64)
    some = x > 0
    out[some] = np.clip(np.round(-np.log2(x[some]) * STEP), 0, CELLS - 2).astype(np.int64) + 1
    return out


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(np.floor(np.log2(np.maximum(c, 1))).astype(np.int64) + 1, CONTEXTS - 1), 0)


def _fold(kind: str, parts):
    """Key, and its counts in the two parts of the learnable texts."""
    names, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = [np.bincount(place, weights=np.concatenate([p[i] for p in parts]), minlength=len(names)).astype(np.uint64) for i in (1, 2)]
    return place, [names, *counts]


def _cut(kind: str, folded, a: int, b: int):
    return [x[a:b] for x in folded]


def _answer(kind: str, folded):
    main, tune = (x.astype(np.int64) for x in folded[1:])
    return [main, tune], [("total", [np.array([main.sum(), tune.sum(), ((main + tune) > 0).sum()], dtype=np.int64)])] if kind == "word" else []


def learn_weights(cells: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """CONTEXTS x 3 weights (bigram, unigram, uniform) by EM; a bucket without data gets a neighbour's mean."""
    value = lambda c: np.where(c > 0, np.exp2(-(c - 1) / STEP), 0.0)
    ctx, rest = np.divmod(cells, CELLS * CELLS)
    p = np.stack([value(rest // CELLS), value(rest % CELLS), np.full(len(cells), 1.0 / (vocabulary + 1))], 1)
    out = np.full((CONTEXTS, 3), np.nan)

    def em(p, n):
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p * w
            share *= (n / np.maximum(share.sum(1), 1e-300))[:, None]
            w = (share.sum(0) + 1e-3) / (n.sum() + 3e-3)
        return w

    whole = em(p, n.astype(float)) if len(cells) else np.full(3, 1 / 3)
    for k in range(CONTEXTS):
        here = ctx == k
        out[k] = em(p[here], n[here].astype(float)) if here.any() else whole
    return out


def lm_score(docs: DataFrame, folds: int = FOLDS, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    packed = pack_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", remainder(folds).cast("int").alias("fold")), block_bytes)
    exchange = Exchange(max(1, -(-packed.count() // BUCKET_BLOCKS)), fan)

    def ask(batches):
        for gid, block in blocks_of(batches):
            tokens = Tokens(block)
            for kind, keys in (("word", tokens.now), ("pair", tokens.pair)):
                names, _, main, tune = tokens.count(keys)
                yield rows_table(list(exchange.request_rows(kind, gid, names, main, tune)))

    got = exchange.answers(packed.mapInArrow(ask, REQUEST), _fold, _answer, _cut, "lm-counts")
    answers = got.filter("gid >= 0")

    def totals(batches):
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in unpack_arrays(blob)[0]], names=["main", "tune", "kinds"])

    t = got.filter("kind = 'total'").select("blob").mapInArrow(totals, "main long, tune long, kinds long").agg(F.sum("main"), F.sum("tune"), F.sum("kinds")).first()
    n_main, n_all, vocabulary = t[0] or 0, (t[0] or 0) + (t[1] or 0), t[2] or 0

    def counts(table: pa.Table, kind: str, keys: np.ndarray):
        """The counts of each token's key in the two parts."""
        parts = answers_of(table, kind)
        number = np.unique(keys, return_inverse=True)[1]
        return joined(parts, 0, np.int64)[number], joined(parts, 1, np.int64)[number]

    def context(tokens: Tokens, count: np.ndarray):
        """The count of the word before each token; of a text's start, that of ends."""
        out = np.empty(len(count), dtype=np.int64)
        out[1:] = count[:-1]
        out[tokens.first[:-1]] = count[tokens.first[1:] - 1]
        return out

    def held_out(gid, block, table):
        """The held-out tokens of a block, by cell."""
        tokens = Tokens(block)
        now, _ = counts(table, "word", tokens.now)
        pair, _ = counts(table, "pair", tokens.pair)
        x, y, m = (c[tokens.tune] for c in (context(tokens, now), now, pair))
        cell = (context_bucket(x) * CELLS + _cell(m / np.maximum(x, 1))) * CELLS + _cell(y / max(n_main, 1))
        cells, n = np.unique(cell, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    cells = settle(per_block(packed, answers, held_out, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), "lm-cells")
    # at most CONTEXTS * CELLS^2 rows
    held = cells.orderBy("cell").toArrow()
    weights = learn_weights(held["cell"].to_numpy(), held["n"].to_numpy(), vocabulary)

    def result(gid, block, table):
        tokens = Tokens(block)
        count = sum(counts(table, "word", tokens.now))
        before = context(tokens, count)
        pair = sum(counts(table, "pair", tokens.pair)).astype(np.float64)
        w = weights[context_bucket(before)]
        p = w[:, 0] * np.minimum(pair / np.maximum(before, 1), 1) + w[:, 1] * count / max(n_all, 1) + w[:, 2] / (vocabulary + 1)
        if not n_all:
            p = np.ones(len(count))
        start = tokens.first[:-1]
        add = lambda x: np.add.reduceat(x, start) if len(start) else np.zeros(0)
        base = add(np.log10((count + 0.1) / (n_all + 0.1 * (vocabulary + 1))))
        yield pa.RecordBatch.from_arrays(
            [
                block["doc_id"].combine_chunks(), pa.array(tokens.fold == 0, pa.bool_()), pa.array(tokens.size, pa.int64()), pa.array(add((count > 0).astype(np.int64)), pa.int64()),
                pa.array(np.full(len(start), n_all), pa.int64()), pa.array(base, pa.float64()), pa.array(add(np.log10(p)), pa.float64()),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return per_block(packed, answers, result, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(read(spark, sf_dir, "documents"))
