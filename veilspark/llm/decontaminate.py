"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased, their white space is folded to one space.  An item of m
characters that occurs in a text with at most k = floor(RATE * m) edits shares with that place at
least t = m + 1 - q * (k + 1) of its q-grams, all within k + 1 neighbouring diagonals.  For every
text the q-grams that it has in common with any item are counted in diagonal bands of twice that
width that overlap by half, so each such place lies whole in some band; bands that reach t are
kept, neighbours are joined, and a banded alignment decides whether the item is there within k
edits.  Items too short for the lemma (t < 1) are looked for as they stand, as whole words, or, if k > 0,
aligned with each text that has one of their k + 1 pieces.

An excerpt counts as well: any part of e = ceil(2/3 m) neighbouring characters of the item, where e
is at least EXCERPT_LEAST, that occurs with at most floor(RATE * e) edits.  The lemma holds for
these parts too, so the bands are tested with their lower threshold, and where the item as a whole
is not found, all its parts of e characters are aligned at once.  Half an item is no finding.

The items' q-grams go to the executors in blocks of at most BLOCK_CHARS characters, whatever the
size of the benchmark: more items mean more passes over the texts, not larger broadcasts.

Defined cases: null or empty text holds nothing; null or empty items are no items; equal items are
each reported; an item found twice in a text is reported once, at its best place (as a whole before
an excerpt, fewest edits, then first; the edits of an excerpt are those within it); repeated rows are each reported; empty tables give an empty result; other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

Q = 8
RATE = 0.08
EXCERPT_LEAST = 50
BLOCK_CHARS = 4 << 20
CHUNK = 1 << 20
_K = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def fold(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = c.astype(np.uint64)
    h = wide[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, q):
            h *= _K
            h += wide[j : j + n]
        return h * _K


class Index:
    """The q-grams of a block of items, sorted, with the item and the place of each."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = RATE):
        self.q, self.items = q, [(i, fold(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if t]
        self.m = np.array([len(t) for _, t in self.items], dtype=np.int64)
        self.k = np.floor(self.m * rate).astype(np.int64)
        self.t = self.m + 1 - q * (self.k + 1)
        self.short = [j for j in range(len(self.items)) if self.t[j] < 1]
        self.part = -(-2 * self.m // 3)
        self.part[self.part < EXCERPT_LEAST] = 0
        self.part_k = np.floor(self.part * rate).astype(np.int64)
        part_t = self.part + 1 - q * (self.part_k + 1)
        self.part[part_t < 1] = 0
        self.least = np.where(self.part > 0, np.minimum(self.t, part_t), self.t)
        grams, item, place = [], [], []
        for j, (_, t) in enumerate(self.items):
            if self.t[j] >= 1:
                h = gram_hashes(codes(t), q)
                grams.append(h)
                item.append(np.full(len(h), j, dtype=np.int64))
                place.append(np.arange(len(h), dtype=np.int64))
        cat = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
        h, item, place = cat(grams, np.uint64), cat(item, np.int64), cat(place, np.int64)
        order = np.lexsort((place, item, h))
        h, self.item, self.place = h[order], item[order], place[order]
        self.hash, self.start, self.count = np.unique(h, return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def regions(self, c: np.ndarray, row: np.ndarray):
        """(item, first and last diagonal, whether it can hold the whole item) of the bands that reach a threshold of their item."""
        if not len(self.hash):
            return []
        h = gram_hashes(c, self.q)
        near = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(near):
            return []
        at = np.minimum(np.searchsorted(self.hash, h[near]), len(self.hash) - 1)
        good = self.hash[at] == h[near]
        near, at = near[good], at[good]
        n = self.count[at]
        first = np.zeros(len(n), dtype=np.int64)
        np.cumsum(n[:-1], out=first[1:])
        entry = np.repeat(self.start[at], n) + np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        pos, item = np.repeat(near, n), self.item[entry]
        width = self.k[item] + 1
        diagonal = pos - self.place[entry] + int(self.m.max(initial=0))
        band = diagonal // width
        size = int(band.max(initial=0)) + 2
        # each gram counts in its band and in the one before, which overlaps it by half
        key = item * size + band
        key.sort()
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        have, count = key[edge], np.diff(np.append(edge, len(key)))
        both = np.zeros(len(have), dtype=np.int64)
        next_to = (have[1:] == have[:-1] + 1)
        both[:-1][next_to] = count[1:][next_to]
        low = have // size
        hit = np.flatnonzero(count + both >= self.least[low])
        out = []
        for x in hit:
            j, b = int(low[x]), int(have[x] % size)
            begin = b * int(self.k[j] + 1) - int(self.m.max(initial=0))
            out.append((j, begin, begin + 2 * int(self.k[j] + 1) - 1, bool(count[x] + both[x] >= self.t[j])))
        # one band before a lone one also holds it; its own test above covers the same grams
        return out


def banded_distance(item: np.ndarray, text: np.ndarray, k: int, low: int | None = None, high: int | None = None) -> tuple[int, int]:
    """Least edits (at most k, else k + 1) that turn item into some part of text, and that part's end.

    Only the diagonals low to high (text place less item place; by default all) and k more on either
    side are filled, since k edits leave a path within k diagonals of where it begins.  Each row is
    one character of the item; a row whose best value exceeds k ends the work.
    """
    d, end, _ = _banded(item, np.zeros(1, np.int64), len(item), text, k, low, high)
    return d, end


def excerpt_distance(item: np.ndarray, text: np.ndarray, size: int, k: int, low: int | None = None, high: int | None = None) -> tuple[int, int]:
    """Least edits (at most k, else k + 1) that turn some size characters of item into some part of text,
    and that part's end; the first end among equals.  As banded_distance, for all parts at once."""
    d, end, _ = _banded(item, np.arange(len(item) - size + 1), size, text, k, low, high)
    return d, end


def _banded(item, at, size, text, k, low, high):
    n, m = len(text), len(item)
    low, high = (-m if low is None else low) - k, (n if high is None else high) + k
    low, high = max(low, -m), min(high, n)
    far = np.int32(1 << 20)
    if high < low:
        return k + 1, 0, 0
    width = high - low + 1
    ramp = np.arange(width, dtype=np.int32)
    place = at[:, None] + low + np.arange(width)[None, :]  # text characters before the cell, in row 0
    padded = np.concatenate((text, np.full(1, 0xFFFFFFFF, dtype=text.dtype)))
    row = np.where((place >= 0) & (place <= n), np.int32(0), far)
    for i in range(size):
        # cell c of the next row ends at place + i + 1; its diagonal neighbour is cell c of this row, its upper one cell c + 1
        seen = place + i
        inside = (seen >= 0) & (seen < n)
        char = padded[np.where(inside, seen, n)]
        step = np.where(inside, row + (char != item[at + i][:, None]), far)
        np.minimum(step[:, :-1], row[:, 1:] + 1, out=step[:, :-1])
        step[(seen + 1 < 0) | (seen + 1 > n)] = far
        row = np.minimum.accumulate(step - ramp, axis=1) + ramp
        row[(seen + 1 < 0) | (seen + 1 > n)] = far
        alive = row.min(axis=1) <= k
        if not alive.all():
            row, at, place = row[alive], at[alive], place[alive]
            if not len(at):
                return k + 1, 0, 0
    least = int(row.min())
    ends = (place + size)[row == least]
    return least, int(ends.min()), int(at[0])


def find_word(text: str, item: str) -> int:
    """The first place where item stands in text and no word runs on past either end of it; -1 for none."""
    at = text.find(item)
    while at >= 0:
        end = at + len(item)
        if not (at and item[0].isalnum() and text[at - 1].isalnum()) and not (end < len(text) and item[-1].isalnum() and text[end].isalnum()):
            return at
        at = text.find(item, at + 1)
    return -1


def find_items(texts: list[str | None], index: Index) -> list[tuple[int, int, int, int]]:
    """(row, item number, edits, end) for each item that a text holds; ends count folded characters."""
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    folded = [fold(t) for t in texts]
    for j in index.short:
        item, k = index.items[j][1], int(index.k[j])
        cuts = [len(item) * x // (k + 1) for x in range(k + 2)]
        pieces = [item[x:y] for x, y in zip(cuts, cuts[1:])]
        for r, t in enumerate(folded):
            at = find_word(t, item) if t else -1
            if at >= 0:
                out[r, j] = (0, 0, at + len(item))
            elif k and t and any(x in t for x in pieces):  # k edits leave one of k + 1 pieces whole
                d, end = banded_distance(codes(item), codes(t), k)
                if d <= k:
                    out[r, j] = (0, d, end)
    item_codes: dict[int, np.ndarray] = {}
    a = 0
    while a < len(folded):
        b, size = a, 0
        while b < len(folded) and (b == a or size + len(folded[b]) <= CHUNK):
            size += len(folded[b]) + 1
            b += 1
        c = codes("\x00".join(folded[a:b]) + "\x00")
        ends = np.cumsum([len(x) + 1 for x in folded[a:b]])
        parts: dict[tuple[int, int], list[tuple[int, int, int, int]]] = {}
        for j, low, high, can in sorted(set(index.regions(c, ends))):
            k, m = int(index.k[j]), int(index.m[j])
            if j not in item_codes:
                item_codes[j] = codes(index.items[j][1])
            begin, stop = max(0, low - k), min(len(c), high + m + k)
            # a region may touch several texts: the separator costs an edit and never matches
            for r in range(int(np.searchsorted(ends, begin, side="right")), min(int(np.searchsorted(ends, max(stop - 1, 0), side="right")), b - a - 1) + 1):
                left = int(ends[r - 1]) if r else 0
                s, e = max(begin, left), min(stop, int(ends[r]) - 1)
                if can and e - s >= m - k:
                    d, end = banded_distance(item_codes[j], c[s:e], k, low - s, high - s)
                    if d <= k:
                        best = (0, d, s - left + end)
                        if (a + r, j) not in out or best < out[a + r, j]:
                            out[a + r, j] = best
                if index.part[j]:
                    spans = parts.setdefault((r, j), [])
                    if spans and low <= spans[-1][3] + 1:
                        spans[-1] = (spans[-1][0], max(e, spans[-1][1]), spans[-1][2], max(high, spans[-1][3]))
                    else:
                        spans.append((s, e, low, high))
        # excerpts, where the item as a whole is not in the text
        for (r, j), spans in parts.items():
            if (a + r, j) in out:
                continue
            left, part, k = int(ends[r - 1]) if r else 0, int(index.part[j]), int(index.part_k[j])
            for s, e, low, high in spans:
                if e - s < part - k:
                    continue
                d, end = excerpt_distance(item_codes[j], c[s:e], part, k, low - s, high - s)
                if d <= k:
                    best = (1, d, s - left + end)
                    if (a + r, j) not in out or best < out[a + r, j]:
                        out[a + r, j] = best
        a = b
    return [(r, j, d, e) for (r, j), (_, d, e) in sorted(out.items())]


def blocks(bench: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items in blocks of bounded size, one at a time on the driver."""
    items = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and text != ''")
    # the number of blocks follows the total; items are spread over blocks by hash
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    if n == 1:
        yield [(r.item_id, r.text) for r in items.collect()]
        return
    spread = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        yield [(r.item_id, r.text) for r in spread.filter(F.col("block") == k).select("item_id", "text").collect()]


def find_contamination(docs: DataFrame, bench: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, end_char: a row for each text and item that it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, edits int, end_char long"
    out = None
    for items in blocks(bench, block_chars):
        shared = spark.sparkContext.broadcast(sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1])))  # bounded by block_chars

        def run(batches, shared=shared):
            index = Index(shared.value)
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    found = find_items(part.column("text").to_pylist(), index)
                    ids = part.column("doc_id").to_pylist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[r] for r, *_ in found], pa.int64()), pa.array([index.items[j][0] for _, j, *_ in found], pa.int64()), pa.array([d for *_, d, _ in found], pa.int32()), pa.array([e for *_, e in found], pa.int64())],
                        names=["doc_id", "item_id", "edits", "end_char"],
                    )

        one = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
