"""Substring dedup by recompression.

Words are named by 64-bit hashes.  These names are verified: distinct words meet by name over all
documents, byte by byte, and if two words share a name, all are named anew under another seed.  Runs of one word are named first; then, round after round, the
names are split in left and right ones by a seeded bit, and each left name followed by a right one
becomes a new name.  Every round is a function of names alone, so equal word sequences get equal
names inside, wherever they stand.  With each name goes the stretch of words that decided it, so
it is known exactly in which windows a name is certain: if the deciding stretch lies in a window,
each equal window holds the same name at the same place.

A window's mark is the first certain name of the highest round that has one.  Consecutive windows
with one mark form a segment, which is again a function of the words alone.  Of each distinct
segment the smallest doc_id is found over all documents; where a mark has one distinct segment
only, that settles its windows.  Where a mark stands in different segments, the windows of one
copy of each are compared one by one.  Segments and windows are equal if two 64-bit polynomials in
the verified names of their words are.  So long repeats cost one entry for each segment, and single
windows count only at the ends of repeats.

Since a name is a function of what it stands for, rounds need no exchange to name globally; all of
a block's run in one pass over it.

Defined cases: null text has no words; documents shorter than a window keep all; a window that
repeats inside one document alone is not removed; a null doc_id is larger than all others; rows
repeating a doc_id do not remove from each other; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, FAN, REQUEST, Exchange, answers_of, blocks_of, joined, pack_arrays, pack_documents, per_block, rows_table, unpack_arrays
from .common import Words, _spread, alike, mix, one_of_each, read, slices

WINDOW = 50
ROUNDS = 11
NULL_ID = 2**63 - 1
SEEDS = 8
#: Words whose names are made at a time.
PART = 1 << 18
_C1, _C2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_FAR = (1 << 30) - 1  # twice that is still an int32
_BITS = mix(np.arange(1, ROUNDS + 2, dtype=np.uint64) * np.uint64(15485863))


class Prefix:
    """Fingerprints of any stretch of a hash array by prefix sums in powers of an odd number."""

    def __init__(self, h: np.ndarray, base: int):
        n = len(h)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, np.uint64(base), dtype=np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            back = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)), dtype=np.uint64)
            back[0] = 1
            self.back = np.cumprod(back, dtype=np.uint64)
            self.sum = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(h * power[:n], dtype=np.uint64, out=self.sum[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sum[end] - self.sum[begin]) * self.back[begin] + (end - begin).astype(np.uint64) * np.uint64(_C2))


def rounds(h: np.ndarray, first: np.ndarray, window: int, n_rounds: int = ROUNDS):
    """(name, first and last deciding place) of each round, for names that some window can hold.

    Names lie one after the other, so a name ends where the next begins; first marks the first of each document.
    """
    n = len(h)
    name, begin, low = h, np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
    high = low + np.int32(1)
    out = []

    def keep():
        good = np.flatnonzero(high - low <= window)
        out.append((name[good], low[good], high[good]))

    keep()
    with np.errstate(over="ignore"):
        # runs of one word; each name now also rests on the words beside it
        new = np.ones(n, dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | first[1:]
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        name, begin, first = name[at], begin[at], first[at]
        run = np.flatnonzero(size > 1)
        name[run] = mix(name[run] * np.uint64(_C1) + size[run].astype(np.uint64))
        low = np.where(first, np.int32(-_FAR), begin - np.int32(1))
        last = np.append(first[1:], True)
        high = np.where(last, np.int32(_FAR), np.append(begin[1:], np.int32(n)) + np.int32(1))
        keep()
        for k in range(n_rounds):
            m = len(name)
            if m < 2:
                break
            right = (mix(name ^ _BITS[k]) >> np.uint64(63)).astype(bool)
            edge = np.append(begin, np.int32(n))
            pair = ~right[:-1] & right[1:]
            pair &= ~first[1:]
            pair &= edge[2:] - edge[:-2] <= window
            head = np.flatnonzero(pair)
            stay = np.ones(m, dtype=bool)
            stay[head + 1] = False
            at = np.flatnonzero(stay)
            # a right name rests on the one before it, a left one on the one after it, if its document has one
            side = right[at]
            low = low[np.where(side, at - 1, at)]
            low[side & first[at]] = -_FAR
            after = np.where(side, at, at + 1)
            high = np.append(high, np.int32(_FAR))[after]
            high[~side & np.append(first, True)[after]] = _FAR
            made = mix(name[head] * np.uint64(_C1) + name[head + 1] * np.uint64(_C2) + np.uint64(1))
            name, begin, first = name[at], begin[at], first[at]
            name[head - np.arange(len(head))] = made
            keep()
    return out


def _marked(h: np.ndarray, off: np.ndarray, window: int):
    """Mark, first window and number of windows of each segment of the words h, whose rows begin at off[:-1]."""
    n, counts = len(h), np.diff(off)
    here = np.maximum(counts - (window - 1), 0)
    at = _spread(off[:-1], here)
    if not len(at):
        return np.zeros(0, np.uint64), at, at
    first = np.zeros(n, dtype=bool)
    first[off[:-1][counts > 0]] = True
    made = rounds(h, first, window)
    # each window's first certain name of the highest round, by its place among the names of all rounds
    base = np.concatenate(([0], np.cumsum([len(x[0]) for x in made])))
    which, todo, slot = np.empty(len(at), np.int32), at, np.arange(len(at))
    for k in range(len(made) - 1, -1, -1):
        _, low, high = made[k]
        if not len(low) or not len(todo):
            continue
        i = np.repeat(np.arange(len(low) + 1, dtype=np.int32), np.diff(low, prepend=-1, append=n - 1))[todo]
        ok = np.append(high, np.int32(_FAR))[i] <= todo + window
        which[slot[ok]] = i[ok] + np.int32(base[k])
        todo, slot = todo[~ok], slot[~ok]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)
    edge = np.flatnonzero(new)
    code = which[edge]
    level = np.searchsorted(base, code, side="right")
    mark = mix(np.concatenate([x[0] for x in made])[code] ^ level.astype(np.uint64))
    return mark, at[edge], np.diff(np.append(edge, len(at)))


class Segments:
    """The segments of a block: mark, first window, number of windows, row; and fingerprints."""

    def __init__(self, table: pa.Table, window: int = WINDOW, seed: int = 0):
        self.window = window
        self.words = Words(table["text"], seed=seed)
        ids = table["doc_id"].to_pylist()
        self.ids = np.array([NULL_ID if i is None else i for i in ids], dtype=np.int64)
        h, first = self.words.hash, self.words.first
        # rows do not bear on each other here, so a few at a time, which a processor's cache can hold
        parts = []
        for a, b in slices(first, PART):
            mark, start, size = _marked(h[first[a] : first[b]], first[a : b + 1] - first[a], window)
            parts.append((mark, start + first[a], size))
        self.mark, self.start, self.size = (np.concatenate([z, *(p[i] for p in parts)]) for i, z in enumerate((np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))))
        self.row = np.searchsorted(first, self.start, side="right") - 1
        self.one, self.two = Prefix(h, _C1), Prefix(h, _C2)
        end = self.start + self.size + window - 1
        self.key, self.key2 = self.one.of(self.start, end), self.two.of(self.start, end)
        self.doc = self.ids[self.row]

    def distinct(self):
        """Order of the segments by content and doc, the first of each content, and its number."""
        order = np.lexsort((self.doc, self.key2, self.key))
        k, k2 = self.key[order], self.key2[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
        number = np.empty(len(order), dtype=np.int64)
        number[order] = np.cumsum(new) - 1
        return order[new], number

    def marks(self):
        """Sorted distinct marks, the one content (or 0 for several) of each, the number of each segment's mark."""
        marks, inverse = np.unique(self.mark, return_inverse=True)
        lo = np.full(len(marks), np.iinfo(np.uint64).max, np.uint64)
        hi = np.zeros(len(marks), np.uint64)
        code = self.key ^ (self.key2 >> np.uint64(1)) | np.uint64(1)
        np.minimum.at(lo, inverse, code)
        np.maximum.at(hi, inverse, code)
        return marks, np.where(lo == hi, lo, np.uint64(0)), inverse

    def open_windows(self, keeper: np.ndarray, several: np.ndarray):
        """Places of the windows to compare one by one: in own segments of marks that vary."""
        pick = np.flatnonzero(several & (keeper == self.doc))
        size = self.size[pick]
        first = np.zeros(len(pick), np.int64)
        np.cumsum(size[:-1], out=first[1:])
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size) + np.repeat(self.start[pick], size)
        return place, np.repeat(self.doc[pick], size)


def _words_at(size: np.ndarray, raw: np.ndarray) -> list[bytes]:
    ends, data = np.cumsum(size).tolist(), raw.tobytes()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _fold(kind: str, parts):
    """Marks: mark, its one content or 0.  Words: name, length, bytes.  Segments and windows: two keys, the smallest doc."""
    if kind == "mark":
        mark, code = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        names, place = np.unique(mark, return_inverse=True)
        lo, hi = np.full(len(names), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(names), np.uint64)
        np.minimum.at(lo, place, code)
        np.maximum.at(hi, place, code)
        return place, [names, np.where(lo == hi, lo, np.uint64(0))]
    if kind == "word":
        name, size, raw = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
        start, (at, place) = np.cumsum(size) - size, one_of_each(name)
        if alike(raw, start, size, at[place]):
            return place, [name[at], size[at], raw[_spread(start[at], size[at])]]
        seen = sorted({x for p in parts for x in zip(p[0].tolist(), _words_at(p[1], p[2]), strict=True)})
        names = np.array([h for h, _ in seen], dtype=np.uint64)
        place = np.searchsorted(names, np.concatenate([p[0] for p in parts]))
        return place, [names, np.array([len(w) for _, w in seen], dtype=np.int64), np.frombuffer(b"".join(w for _, w in seen), np.uint8)]
    if kind == "collided":
        return np.zeros(len(parts), np.int64), [np.zeros(1, np.uint64)]
    key, key2, doc = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2))
    order = np.lexsort((doc, key2, key))
    k, k2 = key[order], key2[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return place, [k[new], k2[new], doc[order][new]]


def _cut(kind: str, folded, a: int, b: int):
    if kind == "word":
        at = np.concatenate(([0], np.cumsum(folded[1])))
        return [folded[0][a:b], folded[1][a:b], folded[2][at[a] : at[b]]]
    return [x[a:b] for x in folded]


def _answer(kind: str, folded):
    if kind == "mark":
        return [(folded[1] == 0).astype(np.uint8)], []
    if kind == "collided":
        return [np.ones(1, np.int64)], [("collided", [np.ones(1, np.int64)])]
    if kind == "word":
        return [np.zeros(len(folded[0]), np.uint8)], [("collided", [np.array([int((folded[0][1:] == folded[0][:-1]).sum())])])]
    return [folded[2]], []


def _collided(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(unpack_arrays(x)[0][0]) for x in batch.column("blob").to_pylist()], pa.int64())], names=["n"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept text's words in text, for each row of docs."""
    packed = pack_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes)
    exchange = Exchange(max(1, packed.count()), fan)

    def ask(seed: int):
        def run(batches):
            for gid, block in blocks_of(batches):
                s = Segments(block, window, seed)
                pick, _ = s.distinct()
                rows = list(exchange.request_rows("segment", gid, s.key[pick], s.key2[pick], s.doc[pick]))
                marks, code, _ = s.marks()
                rows += list(exchange.request_rows("mark", gid, marks, code))
                names, size, raw, clash = s.words.distinct()
                at = np.concatenate(([0], np.cumsum(size)))
                rows += [("word", node, gid, pack_arrays(names[a:b], size[a:b], raw[at[a] : at[b]])) for node, a, b in exchange.first(gid, names)]
                if clash:
                    rows.append(("collided", 0, gid, pack_arrays(np.zeros(1, np.uint64))))
                if rows:
                    yield rows_table(rows)

        return run

    for seed in range(SEEDS):
        asked = packed.mapInArrow(ask(seed), REQUEST)
        first = exchange.answers(asked, _fold, _answer, _cut, "repeat-segments")
        if not (first.filter("kind = 'collided'").mapInArrow(_collided, "n long").agg(F.sum("n")).first()[0] or 0):
            break
    else:
        raise RuntimeError("words share names under all seeds")
    first = first.filter("kind in ('segment', 'mark')")

    def known(s: Segments, table: pa.Table):
        keeper = joined(answers_of(table, "segment"), 0, np.int64)
        several = joined(answers_of(table, "mark"), 0, np.uint8)
        if not len(s.start):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        return keeper[s.distinct()[1]], several[s.marks()[2]].astype(bool)

    def windows(s: Segments, keeper, several):
        place, doc = s.open_windows(keeper, several)
        key, key2 = s.one.of(place, place + window), s.two.of(place, place + window)
        order = np.lexsort((doc, key2, key))
        return place[order], doc[order], key[order], key2[order]

    def folded(doc, key, key2):
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (key2[1:] != key2[:-1])
        return np.flatnonzero(new), np.cumsum(new) - 1

    def ask_windows(gid, block, table):
        s = Segments(block, window, seed)
        _, doc, key, key2 = windows(s, *known(s, table))
        pick, _ = folded(doc, key, key2)
        yield rows_table(list(exchange.request_rows("window", gid, key[pick], key2[pick], doc[pick])))

    second = exchange.answers(per_block(packed, first, ask_windows, REQUEST), _fold, _answer, _cut, "repeat-windows")

    def result(gid, block, table):
        s = Segments(block, window, seed)
        keeper, several = known(s, table)
        n = len(s.words.hash)
        edge = np.zeros(n + 1, dtype=np.int64)
        gone = np.flatnonzero(keeper < s.doc)
        np.add.at(edge, s.start[gone], 1)
        np.add.at(edge, s.start[gone] + s.size[gone] + window - 1, -1)
        place, doc, key, key2 = windows(s, keeper, several)
        if len(place):
            best = joined(answers_of(table, "window"), 0, np.int64)[folded(doc, key, key2)[1]]
            hit = place[best < doc]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
        removed = np.cumsum(edge[:-1]) > 0
        first_word = s.words.first
        total = np.concatenate(([0], np.cumsum(removed)))
        n_removed = total[first_word[1:]] - total[first_word[:-1]]
        raw, digests, kept = s.words.raw.tobytes(), [], []
        for r in range(len(first_word) - 1):
            words = raw[s.words.off[r] : s.words.off[r + 1]].split()
            if n_removed[r]:
                words = [w for w, x in zip(words, removed[first_word[r] : first_word[r + 1]].tolist(), strict=True) if not x]
            text = b" ".join(words)
            digests.append(hashlib.sha256(text).hexdigest())
            kept.append(text)
        yield pa.RecordBatch.from_arrays(
            [block["doc_id"].combine_chunks() if block["doc_id"].num_chunks else pa.array([], pa.int64()), pa.array(np.diff(first_word), pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )

    return per_block(packed, first.unionByName(second), result, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
