"""Spans of whole batches of texts, on arrays.

The rules of functions.patterns for many texts at once, with the results of the expressions of
functions.spans (tests compare the two).  Every pattern but the address begins or ends at word
boundaries, so texts are cut into words once, and the patterns are conditions on neighbouring words
and the gaps between them.  Work is linear in the text; a batch is taken in pieces of bounded size.

Offsets are code points.  Words, digits and white space are Java's: digits and white space are
ASCII; a letter or digit of any script, and a mark upon one, belongs to a word.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import patterns as P

#: Code points of text that are worked on at a time (a longer text is a piece of its own).
PIECE = 1 << 20
#: Entries that a worker's dictionaries of name verdicts and tokens hold at most.
REMEMBERED = 1 << 16

UPPER, LOWER, DIGIT, WORD, SPACE, OTHER = 1, 2, 4, 8, 16, 32
_WORDY = UPPER | LOWER | DIGIT | WORD
#: What stands for characters beyond ASCII: those of words, and all others.
_LETTER, _SIGN = 0x80, 0x81
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = UPPER, LOWER, DIGIT
_CLASS[[ord("_"), _LETTER]] = WORD
_CLASS[[ord(c) for c in " \t\n\x0b\f\r"]] = SPACE

_MONTHS = "January February March April May June July August September October November December".split()
_ADDRESS = next(p for kind, p in P.DETECTION if kind == "ADDRESS")
_STREETS = frozenset(re.search(r"\(\?:(Street[\w|]*)\)", _ADDRESS)[1].split("|"))
#: Python's \d and \s know other scripts; Java's do not.
_ADDRESS_RULE = re.compile(_ADDRESS.replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]"))
_ZERO, _NOTHING = pa.scalar("\0", pa.large_string()), pa.scalar("", pa.large_string())
_NAMED_DATE = P.DETECTION[2][1].removeprefix("(?i)")


def _fold(text: str) -> np.ndarray:
    """A byte for each code point: ASCII as it is, others by whether they belong to words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.where(points < 128, points, _SIGN).astype(np.uint8)
    far = np.flatnonzero(points >= 128)
    kinds = {c: unicodedata.category(chr(c)) for c in np.unique(points[far]).tolist()}
    marks = []
    for at, c in zip(far.tolist(), points[far].tolist()):
        kind = kinds[c]
        if kind[0] == "L" or kind == "Nd":
            out[at] = _LETTER
        elif kind == "Mn":
            marks.append(at)
    for at in marks:  # in order: a mark before this one is settled
        before = out[at - 1] if at else 0
        if before == _LETTER or (_CLASS[before] & (UPPER | LOWER | DIGIT)):
            out[at] = _LETTER
    return out


def greedy(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the spans, sorted by start, stay when each that stays bars those that begin before its end."""
    n = len(starts)
    taken = np.zeros(n, bool)
    if not n:
        return taken
    head = np.ones(n, bool)
    head[1:] = starts[1:] >= np.maximum.accumulate(ends)[:-1]
    after = np.searchsorted(starts, ends, "left")
    at = np.flatnonzero(head)
    while len(at):
        taken[at] = True
        at = after[at]
        at = at[at < n]
        at = at[~head[at]]
    return taken


def _bytes8(codes: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (codes ends with eight zeros)."""
    return np.ndarray(len(codes) - 7, "<u8", codes, 0, (1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MEDICAID = np.uint64(int.from_bytes(bytes([UPPER, UPPER, *[DIGIT] * 6]), "little"))


class Piece:
    """Some texts in a row, each between two zero bytes, cut into words.

    Word k is codes[start[k]:end[k]]; gap k stands behind it, and ends where word k + 1 begins.
    """

    def __init__(self, texts: pa.Array):
        joined = pc.binary_join_element_wise(texts, _ZERO, _NOTHING)
        raw = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        raw = raw[at[0] : at[-1]]
        if len(raw) and raw.max() > 127:
            rows = [r.decode("utf-8", "replace") for r in joined.cast(pa.large_binary()).to_pylist()]
            self.text = "\0" + "".join(rows)
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            body, self.ascii = _fold(self.text)[1:], False
        else:
            self.text, self.ascii = "\0" + raw.tobytes().decode("ascii"), True
            body, lengths = raw, np.diff(at)
        self.codes = np.concatenate([np.zeros(1, np.uint8), body, np.zeros(16, np.uint8)])
        #: Where each text begins; one more for what follows the last text's closing zero.
        self.rows = np.concatenate([[1], 1 + np.cumsum(lengths)])
        self.n = len(lengths)
        classes = _CLASS[self.codes]
        wordy = (classes & _WORDY) != 0
        edges = np.flatnonzero(wordy[1:] != wordy[:-1]) + 1
        self.start, self.end = edges[0::2], edges[1::2]
        first = classes[edges]
        rest = classes.copy()
        rest[edges] = 0
        rest = np.bitwise_or.reduceat(rest, edges) if len(edges) else rest[:0]
        self.classes, self.head, self.rest = classes, first[0::2], rest[0::2]
        self.size = self.end - self.start
        self.gap_code, self.gap_rest = self.codes[self.end], rest[1::2]
        self.gap_size = np.append(self.start[1:], len(self.codes))[: len(self.end)] - self.end
        space = self.gap_rest == SPACE
        #: White space alone; a comma or a dot before white space; one character alone.
        self.blank = (first[1::2] == SPACE) & (space | (self.gap_rest == 0))
        self.comma, self.dot = (self.gap_code == ord(",")) & space, (self.gap_code == ord(".")) & space
        self.single = self.gap_size == 1
        self.number = (self.head == DIGIT) & ((self.rest == DIGIT) | (self.size == 1))
        self.capital = (self.head == UPPER) & (self.rest == LOWER)
        self.found: dict = {}

    def gap_is(self, char: str) -> np.ndarray:
        return self.single & (self.gap_code == ord(char))

    def digits(self, *sizes: int) -> np.ndarray:
        key = ("digits", *sizes)
        if key not in self.found:
            self.found[key] = self.number & (self.size >= min(sizes)) & (self.size <= max(sizes))
        return self.found[key]

    def at(self, mask: np.ndarray, *more: np.ndarray) -> np.ndarray:
        """The words k for which mask[k], more[0][k + 1] and so on hold."""
        k = np.flatnonzero(mask)
        for step, m in enumerate(more, 1):
            k = k[k + step < len(m)]
            k = k[m[k + step]]
        return k

    def words(self, k: np.ndarray) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[k].tolist(), self.end[k].tolist())]

    def texts(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def row_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.rows, starts, "right") - 1

    # ------------------------------------------------------------------ patterns

    def find(self, pattern: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of a pattern's matches, left to right, as places in the piece."""
        if pattern not in self.found:
            starts, ends = _FINDERS[pattern](self)
            keep = greedy(starts, ends)
            self.found[pattern] = starts[keep], ends[keep]
        return self.found[pattern]

    def _slashed(self, year: int):
        short, slash = self.digits(1, 2), self.gap_is("/")
        k = self.at(short & slash, short & slash, self.digits(year))
        return self.start[k], self.end[k + 2]

    def _named(self, months, one_space: bool = False, lower: bool = False):
        blank, comma = self.blank, self.comma
        if one_space:
            blank, comma = self.gap_is(" "), comma & (self.gap_size == 2) & (self.codes[self.end + 1] == ord(" "))
            between = comma
        else:
            between = blank | comma
        k = self.at(blank, self.digits(1, 2) & between, self.digits(4))
        named = [(w.lower() if lower else w) in months for w in self.words(k)]
        k = k[np.array(named, bool)]
        return self.start[k], self.end[k + 2]

    def _medicaid(self):
        k = np.flatnonzero((self.size == 8) & (self.head == UPPER))
        k = k[_bytes8(self.classes)[self.start[k]] == _MEDICAID]
        return self.start[k], self.end[k]

    def _phone(self, area: str | None = None):
        three, dash = self.digits(3), self.gap_is("-")
        k = self.at(three & dash, three & dash, self.digits(4))
        if area:
            k = k[np.array([w == area for w in self.words(k)], bool)]
        return self.start[k], self.end[k + 2]

    def _bracketed_phone(self):
        three = self.digits(3)
        close = (self.gap_code == ord(")")) & ((self.gap_rest == 0) | (self.gap_rest == SPACE))
        k = self.at(self.gap_is("("), three & close, three & self.gap_is("-"), self.digits(4))
        return self.end[k], self.end[k + 3]

    def _addresses(self):
        k = np.flatnonzero(self.comma & self.capital)
        k = k[np.array([w in _STREETS for w in self.words(k)], bool)]
        # a match begins in the run of words, with white space alone between them, that ends in the street
        runs = np.maximum.accumulate(np.where(self.blank, 0, np.arange(1, len(self.blank) + 1)))
        first = self.start[np.where(k > 0, runs[k - 1], 0)] if len(k) else k
        stops = self.rows[self.row_of(self.start[k]) + 1] - 1
        places, last = [], 0
        for street, begin, stop in zip(self.start[k].tolist(), first.tolist(), stops.tolist()):
            found = _ADDRESS_RULE.search(self.text, max(begin, last), stop) if street >= last else None
            if found and found.start() < street:
                places.append(found.span())
                last = found.end()
        both = np.array(places, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _literal(self, words: list[str], gaps: list[str]):
        """Words with single characters between them; a last gap stands right before another word."""
        if "eights" not in self.found:
            capital = np.flatnonzero(self.head == UPPER)
            self.found["eights"] = capital, _bytes8(self.codes)[self.start[capital]] & _MASKS[np.minimum(self.size[capital], 8)]
        capital, eights = self.found["eights"]
        word = words[0].encode()
        k = capital[(eights == np.uint64(int.from_bytes(word[:8], "little")))]
        k = k[self.size[k] == len(word)]
        k = k[k + len(gaps) < len(self.start)] if gaps else k
        for step, gap in enumerate(gaps):
            k = k[(self.gap_size[k + step] == 1) & (self.gap_code[k + step] == ord(gap))]
        if len(gaps) == len(words):
            starts, ends = self.start[k], self.start[k + len(gaps)]
        else:
            starts, ends = self.start[k], self.end[k + len(gaps)]
        whole = "".join(w + g for w, g in zip(words, [*gaps, ""]))
        same = np.array([t == whole for t in self.texts(starts, ends)], bool)
        return starts[same], ends[same]

    def _names(self):
        capital, blank = self.capital, self.blank
        two = self.at(capital & blank, capital)
        initial = (self.head == UPPER) & (self.size == 1) & (blank | self.dot)
        three = self.at(capital & blank, initial, capital)
        starts, ends = np.concatenate([self.start[two], self.start[three]]), np.concatenate([self.end[two + 1], self.end[three + 2]])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def names(self, rules: str) -> tuple[np.ndarray, np.ndarray]:
        """As spans.name_spans."""
        starts, ends = self.find(P.NAME)
        keep = np.array(_recalled(_verdicts(rules), self.texts(starts, ends), _IS_NAME[rules]), bool)
        return starts[keep], ends[keep]

    def listed(self, names: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words that are names of a list, as spans.gazetteer_spans."""
        k = np.arange(len(self.start)) if any(not n[0].isascii() or n[0].islower() for n in names) else np.flatnonzero(self.head == UPPER)
        k = k[np.array([w in names for w in self.words(k)], bool)]
        return self.start[k], self.end[k]

    # ------------------------------------------------------------------ sets of spans

    def gather(self, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> Spans:
        """Candidates in order of emission: parts are (kind, starts, ends)."""
        starts, ends = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        kinds = np.repeat(np.array([p[0] for p in parts], np.int8), [len(p[1]) for p in parts])
        rows = self.row_of(starts)
        order = np.argsort(rows, kind="stable")  # each part is in order, and parts follow one another
        return Spans(self, rows[order], starts[order], ends[order], kinds[order])

    def raw(self, names: tuple[np.ndarray, np.ndarray] | None = None) -> Spans:
        """As deidentify.detect_raw with the built-in rules."""
        parts = [(_KIND["PERSON"], *(names or self.names("fixed")))]
        return self.gather(parts + [(_KIND[kind], *self.find(p)) for kind, p in P.DETECTION])

    def detected(self) -> Spans:
        """As deidentify.detect."""
        raw = self.raw()
        order = np.lexsort((np.arange(len(raw.start)), raw.start - raw.end, raw.start))
        order = order[greedy(raw.start[order], raw.end[order])]
        return Spans(self, raw.row[order], raw.start[order], raw.end[order], raw.kind[order], raw.seq[order])

    def annotated(self, rules: str) -> Spans:
        """As deidentify.annotate."""
        raw = self.gather([(_KIND[kind], *self.find(p)) for kind, p in P.TRUTH[rules]] + [(_KIND["PERSON"], *self.names(rules))])
        order = np.lexsort((np.arange(len(raw.start)), raw.start))
        same = np.lexsort((order, raw.kind[order], raw.end[order], raw.start[order]))
        again = np.zeros(len(order), bool)
        alike = (raw.start[order[same]][1:] == raw.start[order[same]][:-1]) & (raw.end[order[same]][1:] == raw.end[order[same]][:-1]) & (raw.kind[order[same]][1:] == raw.kind[order[same]][:-1])
        again[same[1:][alike]] = True
        order = order[~again]
        return Spans(self, raw.row[order], raw.start[order], raw.end[order], raw.kind[order])


class Spans:
    """Spans of a piece, by text: row, place in the piece (start, end), kind, and seq (the place in the row by default)."""

    def __init__(self, piece: Piece, row, start, end, kind, seq=None):
        self.piece, self.row, self.start, self.end, self.kind = piece, row, start, end, kind
        self.count = np.bincount(row, minlength=piece.n)
        self.seq = np.arange(len(row)) - np.repeat(np.cumsum(self.count) - self.count, self.count) if seq is None else seq

    def texts(self) -> list[str]:
        return self.piece.texts(self.start, self.end)

    def text_array(self) -> pa.Array:
        if not self.piece.ascii:
            return pa.array(self.texts(), pa.string())
        sizes = self.end - self.start
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        data = self.piece.codes[np.arange(offsets[-1]) + np.repeat(self.start - offsets[:-1], sizes)]
        return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])

    def to_lists(self) -> pa.Array:
        """Arrays of spans.SPAN, one for each text."""
        base = self.piece.rows[self.row]
        columns = [pa.array(x.astype(np.int32)) for x in (self.start - base, self.end - base)] + [_KIND_NAMES.take(pa.array(self.kind)), self.text_array(), pa.array(self.seq.astype(np.int32))]
        offsets = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(SPAN_TYPE)), type=pa.list_(SPAN_TYPE))

    # ------------------------------------------------------------------ matches

    def strict(self, truth: Spans) -> np.ndarray:
        """Equal spans of each text on both sides; each side holds a span once."""
        if not len(self.start):
            return np.zeros(self.piece.n, np.int64)
        at = np.minimum(np.searchsorted(self.start, truth.start), len(self.start) - 1)  # predictions are disjoint: one for each start
        same = (self.start[at] == truth.start) & (self.end[at] == truth.end) & (self.kind[at] == truth.kind)
        return np.bincount(truth.row[same], minlength=self.piece.n)

    def relaxed(self, truth: Spans) -> np.ndarray:
        """Each prediction in order takes the first free truth of its kind that it overlaps."""
        hits = np.zeros(self.piece.n, np.int64)
        starts, ends, kinds = truth.start.tolist(), truth.end.tolist(), truth.kind.tolist()
        begin = (np.cumsum(truth.count) - truth.count).tolist()
        stop = np.cumsum(truth.count).tolist()
        used, at, last = [False] * len(starts), 0, -1
        for row, a, b, kind in zip(self.row.tolist(), self.start.tolist(), self.end.tolist(), self.kind.tolist()):
            if row != last:
                at, last, to = begin[row], row, stop[row]
            # truths are sorted by start; those that end before all predictions to come are passed for good
            while at < to and (used[at] or ends[at] <= a):
                at += 1
            k = at
            while k < to and starts[k] < b:
                if kinds[k] == kind and ends[k] > a and not used[k]:
                    used[k] = True
                    hits[row] += 1
                    break
                k += 1
        return hits


_FINDERS = {
    P.DETECTION[0][1]: lambda p: p._slashed(4),
    P.DETECTION[1][1]: lambda p: p._slashed(2),
    P.DETECTION[2][1]: functools.partial(Piece._named, months=frozenset(m.lower() for m in _MONTHS), lower=True),
    _NAMED_DATE: functools.partial(Piece._named, months=frozenset(_MONTHS)),
    P.LEGACY_DATE: functools.partial(Piece._named, months=frozenset(_MONTHS), one_space=True),
    r"\b[A-Z]{2}\d{6}\b": Piece._medicaid,
    r"\b\d{3}-\d{3}-\d{4}\b": Piece._phone,
    r"\b315-\d{3}-\d{4}\b": functools.partial(Piece._phone, area="315"),
    r"\b\(\d{3}\)\s*\d{3}-\d{4}\b": Piece._bracketed_phone,
    _ADDRESS: Piece._addresses,
    P.NAME: Piece._names,
}
for _kind, _p in [*P.DETECTION, *P.TRUTH_FIXED]:
    if _kind == "CREDENTIAL":
        _plain = _p.removeprefix(r"\b").removesuffix(r"\b").replace("\\", "")
        _words = re.findall(r"\w+", _plain)
        _gaps = [g for g in re.split(r"\w+", _plain)[1:] if g]
        _FINDERS[_p] = functools.partial(Piece._literal, words=_words, gaps=_gaps)

KINDS = ["PERSON", "DATE", "MEDICAID_ID", "PHONE", "ADDRESS", "CREDENTIAL"]
_KIND, _KIND_NAMES = {k: i for i, k in enumerate(KINDS)}, pa.array(KINDS, pa.string())
SPAN_TYPE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("seq", pa.int32())])


@functools.cache
def _verdicts(rules: str) -> dict[str, bool]:
    return {}


def _recalled(known: dict, keys: list, make) -> list:
    """make of each key, remembered in known."""
    if len(known) > REMEMBERED:
        known.clear()
    out = list(map(known.get, keys))
    if None in out:
        for i, x in enumerate(out):
            if x is None:
                key = keys[i]
                out[i] = known[key] = known[key] if key in known else make(key)
    return out


_PHRASES = re.compile("|".join(p.lower() for p in P.FIXED_PHRASES))
_SKIPS = re.compile("|".join(P.LEGACY_SKIP))


def _is_fixed(name: str) -> bool:
    # candidates are ASCII by their shape, and begin with capitals
    words = re.split(r"[ \t\n\x0b\f\r]+", name)
    return not _PHRASES.search(name.lower()) and len(words) in (2, 3) and len(words[0]) <= 15 and 2 <= len(words[-1]) <= 20 and words[0] not in P.FIXED_STARTS


_IS_NAME = {"fixed": _is_fixed, "legacy": lambda name: not _SKIPS.search(name)}


def pieces(texts: pa.Array) -> Iterator[Piece]:
    """A batch of texts, null counting as empty, in pieces of about PIECE."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at, before = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, before + PIECE, "right")))
        yield Piece(texts.slice(at, to - at))
        at, before = to, ends[to - 1]


# ------------------------------------------------------------------ sanitizing


_LABELS = [f"[{kind}]" for kind in KINDS]
_HYBRID = [{"PERSON": "replace", "PHONE": "replace", "ADDRESS": "replace", "DATE": "mask", "MEDICAID_ID": "hash"}.get(kind, "") for kind in KINDS]
_KNOWN_HASHES: dict[str, str] = {}


def _mask(text: str) -> str:
    return text[0] + "*" * (len(text) - 2) + text[-1] if len(text) > 2 else "*" * len(text)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def tokens(spans: Spans, texts: list[str], method: str) -> list[str]:
    """As spans.token; texts: those of the spans."""
    if method == "replace":
        return [_LABELS[k] for k in spans.kind.tolist()]
    if method == "mask":
        return list(map(_mask, texts))
    if method == "hash":
        return _recalled(_KNOWN_HASHES, texts, _hash)
    if method != "hybrid":
        return texts
    make = {"replace": None, "mask": _mask, "hash": _hash, "": str}
    makes = [make[m] for m in _HYBRID]
    return [makes[k](t) if makes[k] else _LABELS[k] for k, t in zip(spans.kind.tolist(), texts)]


def gaps(spans: Spans) -> list[str]:
    """What the piece's text has before, between and behind its spans (disjoint, sorted)."""
    return spans.piece.texts(np.concatenate([[0], spans.end]), np.append(spans.start, len(spans.piece.text)))


def sanitized(spans: Spans, method: str, texts: list[str] | None = None, between: list[str] | None = None) -> list[str]:
    """The texts of the piece with each span rewritten."""
    return woven(spans, gaps(spans) if between is None else between, tokens(spans, spans.texts() if texts is None else texts, method))


def woven(spans: Spans, between: list[str], new: list[str]) -> list[str]:
    both = [""] * (2 * len(new) + 1)
    both[::2], both[1::2] = between, new
    whole = "".join(both)
    grown = np.fromiter(map(len, new), np.int64, len(new)) - (spans.end - spans.start)
    more = np.concatenate([[0], np.cumsum(np.bincount(spans.row, grown, minlength=spans.piece.n).astype(np.int64))])
    at = (spans.piece.rows + more).tolist()
    return [whole[a : b - 1] for a, b in zip(at, at[1:])]


def removed(spans: Spans, texts: list[str], rewritten: list[str]) -> np.ndarray:
    """The number of spans of each text that are nowhere in the rewritten one."""
    gone = [t not in rewritten[r] for r, t in zip(spans.row.tolist(), texts)]
    return np.bincount(spans.row[np.array(gone, bool)], minlength=spans.piece.n)


_TERM = re.compile("[a-z0-9]+")


def _terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _placed_terms(text: str) -> tuple[list[str], np.ndarray]:
    """The words of an ASCII text, and where they begin."""
    inside = np.zeros(len(text) + 2, bool)
    inside[1:-1] = (_CLASS[np.frombuffer(text.encode("ascii"), np.uint8)] & (UPPER | LOWER | DIGIT)) != 0
    return _terms(text), np.flatnonzero(inside[1:] & ~inside[:-1])


def term_products(spans: Spans, between: list[str], rewritings: list[list[str]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """xx of each text, and (xy, yy) for each way to rewrite its spans, given by their tokens.

    x and y are the counts of words of a text and of the rewritten one; xy is the sum of x * y over words.
    Where no word reaches over the edge of a span, a rewritten text has the words of the text without
    those in spans, and those of the tokens: only these are counted anew.
    """
    piece, n = spans.piece, spans.piece.n
    within = UPPER | LOWER | DIGIT
    edge = ((piece.classes[spans.start - 1] | piece.classes[spans.end]) & within) != 0
    alone = np.flatnonzero(np.bincount(spans.row[edge], minlength=n)) if piece.ascii else np.arange(n)
    xx, out = np.zeros(n, np.int64), [(np.zeros(n, np.int64), np.zeros(n, np.int64)) for _ in rewritings]
    if piece.ascii:
        words, at = _placed_terms(piece.text)
        rows, many = [piece.row_of(at)], [len(words)]
        for tokens in rewritings:
            more, places = _placed_terms("\0".join(tokens))
            begins = np.cumsum([0, *[len(t) + 1 for t in tokens]])
            rows.append(spans.row[np.searchsorted(begins, places, "right") - 1])
            many.append(len(more))
            words += more
        encoded = pa.array(words, pa.string()).dictionary_encode()
        keys = np.concatenate(rows) * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy(zero_copy_only=False)
        text, *added = np.split(keys, np.cumsum(many)[:-1])
        key, place, x = np.unique(text, return_inverse=True, return_counts=True)
        if len(spans.start):
            span = np.searchsorted(spans.start, at, "right") - 1
            kept = (span < 0) | (at >= spans.end[span])
        else:
            kept = np.ones(len(at), bool)
        g = np.bincount(place[kept], minlength=len(key))
        row = key // max(1, len(encoded.dictionary))
        total = lambda r, values: np.bincount(r, values, minlength=n).astype(np.int64)
        xx, xg, gg = total(row, x * x), total(row, x * g), total(row, g * g)
        for i, keys in enumerate(added):
            new, t = np.unique(keys, return_counts=True)
            k = np.searchsorted(key, new)
            k[k == len(key)] = 0
            known = key[k] == new if len(key) else np.zeros(len(new), bool)
            was_x, was_g = (np.where(known, c[k], 0) if len(key) else 0 * t for c in (x, g))
            row = new // max(1, len(encoded.dictionary))
            out[i] = xg + total(row, was_x * t), gg + total(row, 2 * was_g * t + t * t)
    if len(alone):
        bounds, made = piece.rows.tolist(), [woven(spans, between, tokens) for tokens in rewritings]
        for r in alone.tolist():
            x = Counter(_terms(piece.text[bounds[r] : bounds[r + 1] - 1]))
            xx[r] = sum(v * v for v in x.values())
            for (xy, yy), texts in zip(out, made):
                y = Counter(_terms(texts[r]))
                xy[r], yy[r] = sum(v * y.get(w, 0) for w, v in x.items()), sum(v * v for v in y.values())
    return xx, out
