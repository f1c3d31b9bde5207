"""Arrow UDFs over functions.batches: a text in, spans, counts or rewritten texts out.

Only texts (or their keys) enter a worker and only what a query needs leaves it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from . import batches as B
from . import note_batches
from . import patterns as P
from .spans import SPAN

_SPANS = f"array<{SPAN}>"
KINDS = B.KINDS


def _by_text(make: Callable[[B.Piece], pa.Array], ddl: str, empty: pa.DataType) -> Callable[[Column], Column]:
    """A UDF of a text column from a function of pieces; a null text counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([make(p) for p in B.pieces(texts)]) if len(texts) else pa.array([], empty)

    return arrow_udf(run, ddl)


def _lists(make: Callable[[B.Piece], B.Spans]) -> Callable[[Column], Column]:
    return _by_text(lambda piece: make(piece).to_lists(), _SPANS, pa.list_(B.SPAN_TYPE))


def note_text(key: Column, seed: int = 42) -> Column:
    """The text of a key's note."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(note_batches.note_texts(keys.to_numpy(zero_copy_only=False), seed), pa.string())

    return arrow_udf(run, "string")(key)


def raw_spans(text: Column) -> Column:
    return _lists(lambda piece: piece.raw())(text)


def detected(text: Column) -> Column:
    return _lists(lambda piece: piece.detected())(text)


def annotated(text: Column, rules: str) -> Column:
    return _lists(lambda piece: piece.annotated(rules))(text)


def kind_spans(text: Column, kind: str) -> Column:
    """Candidates of one kind that detection looks for."""
    patterns = [p for k, p in P.DETECTION if k == kind]
    return _lists(lambda piece: piece.gather([(B.KINDS.index(kind), *piece.find(p)) for p in patterns]))(text)


def name_spans(text: Column, rules: str) -> Column:
    return _lists(lambda piece: piece.gather([(0, *piece.names(rules))]))(text)


def listed_spans(text: Column, names: list[str]) -> Column:
    found = frozenset(n for n in names if n.isalpha())
    return _lists(lambda piece: piece.gather([(0, *piece.listed(found))]))(text)


def _struct(**columns) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def _longs(*names: str) -> tuple[str, pa.DataType]:
    return f"struct<{', '.join(f'{n}: bigint' for n in names)}>", pa.struct([(n, pa.int64()) for n in names])


def match_counts(text: Column, mode: str, rules: str) -> Column:
    """struct<tp, np, nt> of the detected spans of a text against the annotated ones."""

    def make(piece: B.Piece) -> pa.Array:
        pred, truth = piece.detected(), piece.annotated(rules)
        return _struct(tp=getattr(pred, mode)(truth), np=pred.count, nt=truth.count)

    return _by_text(make, *_longs("tp", "np", "nt"))(text)


def span_count(text: Column, rules: str | None = None) -> Column:
    """The number of detected spans; with rules, of annotated ones."""
    return _by_text(lambda piece: pa.array((piece.annotated(rules) if rules else piece.detected()).count, pa.int64()), "bigint", pa.int64())(text)


def kind_counts(text: Column, rules: str = "") -> Column:
    """struct<truth, pred>: arrays of the numbers of annotated (with rules) and detected spans, by place in KINDS."""
    n = len(KINDS)

    def table(piece: B.Piece, spans: B.Spans | None) -> pa.Array:
        counts = np.bincount(spans.row * n + spans.kind, minlength=piece.n * n) if spans else np.zeros(piece.n * n, np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, piece.n * n + 1, n, dtype=np.int32)), pa.array(counts, pa.int64()))

    def make(piece: B.Piece) -> pa.Array:
        return pa.StructArray.from_arrays([table(piece, piece.annotated(rules) if rules else None), table(piece, piece.detected())], names=["truth", "pred"])

    long_list = pa.list_(pa.int64())
    return _by_text(make, "struct<truth: array<bigint>, pred: array<bigint>>", pa.struct([("truth", long_list), ("pred", long_list)]))(text)


def span_names(spans: Column) -> Column:
    """Names of the spans of an array, unlike for unlike (start, end, type); equal ones are numbered.  Null stays."""

    def run(lists: pa.Array) -> pa.Array:
        flat, sizes = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        start, end, kind = (flat.field(name) for name in ("start", "end", "type"))
        codes = kind.dictionary_encode().indices.fill_null(-1)
        columns = [x.to_numpy(zero_copy_only=False) for x in (codes, end.fill_null(-1), start.fill_null(-1))] + [np.repeat(np.arange(len(sizes)), sizes)]
        order = np.lexsort(columns)
        alike = np.zeros(len(order), bool)
        alike[1:] = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
        places = np.arange(len(order))
        again = np.empty(len(order), np.int64)
        again[order] = places - np.maximum.accumulate(np.where(alike, 0, places))
        names = pc.binary_join_element_wise(*(pc.fill_null(x.cast(pa.string()), "") for x in (start, end, pa.array(again), kind)), ",")
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, names, mask=lists.is_null() if lists.null_count else None)

    return arrow_udf(run, "array<string>")(spans)


def sanitized(text: Column, method: str) -> Column:
    """The text with its detected spans rewritten; of a null text nothing."""

    def run(texts: pa.Array) -> pa.Array:
        out = [pa.array(B.sanitized(p.detected(), method), pa.string()) for p in B.pieces(texts)]
        made = pa.concat_arrays(out) if out else pa.array([], pa.string())
        return pc.if_else(texts.is_valid(), made, pa.scalar(None, pa.string())) if texts.null_count else made

    return arrow_udf(run, "string")(text)


def _nested(columns: dict[str, list[np.ndarray]]) -> pa.Array:
    """Arrays of structs from, for each field, the values of each place in the arrays."""
    wide = {name: np.stack(values, axis=1) for name, values in columns.items()}
    n, each = next(iter(wide.values())).shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * each + 1, each, dtype=np.int32)), _struct(**{name: v.ravel() for name, v in wide.items()}))


def removals(text: Column, methods: tuple[str, ...]) -> Column:
    """array<struct<found, gone>>: by method, the detected spans and those whose text is nowhere in the sanitized one."""
    ddl, kind = _longs("found", "gone")

    def make(piece: B.Piece) -> pa.Array:
        spans = piece.detected()
        texts, gaps = spans.texts(), B.gaps(spans)
        gone = [B.removed(spans, texts, B.sanitized(spans, m, texts, gaps)) for m in methods]
        return _nested({"found": [spans.count] * len(methods), "gone": gone})

    return _by_text(make, f"array<{ddl}>", pa.list_(kind))(text)


def similarities(text: Column, methods: tuple[str, ...]) -> Column:
    """array<struct<found, gone, xy, xx, yy>>: as removals, with the products of word counts of text and sanitized text."""
    names = ("found", "gone", "xy", "xx", "yy")
    ddl, kind = _longs(*names)

    def make(piece: B.Piece) -> pa.Array:
        spans = piece.detected()
        texts, gaps = spans.texts(), B.gaps(spans)
        tokens = [B.tokens(spans, texts, m) for m in methods]
        xx, products = B.term_products(spans, gaps, tokens)
        out = {name: [] for name in names}
        for new, (xy, yy) in zip(tokens, products, strict=True):
            for name, values in zip(names, (spans.count, B.removed(spans, texts, B.woven(spans, gaps, new)), xy, xx, yy), strict=True):
                out[name].append(values)
        return _nested(out)

    return _by_text(make, f"array<{ddl}>", pa.list_(kind))(text)


def hash_tokens(text: Column) -> Column:
    """The distinct hash tokens of the detected spans of a text, as numbers."""

    def make(piece: B.Piece) -> pa.Array:
        spans = piece.detected()
        values = np.array([int(t, 16) for t in B.tokens(spans, spans.texts(), "hash")], np.int64)
        order = np.lexsort((values, spans.row))
        row, values = spans.row[order], values[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=piece.n))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[first]))

    return _by_text(make, "array<bigint>", pa.list_(pa.int64()))(text)
