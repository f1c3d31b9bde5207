"""Licence scans: phrases and identifier tags by one Aho-Corasick automaton, and licence
expressions evaluated by a shunting-yard parser.

Words: A-Z lower-cased, then maximal runs of letters, digits and all non-ASCII characters.  A
phrase is found where its words stand consecutively, whatever stands between them.  Identifier
tags (the machine-readable one-line form) are found in the same pass; the expression behind a tag
is parsed with precedence with > and > or, and evaluated to the licences that a reader must keep to
in its least demanding reading: "or" takes the side that asks less (by DEMAND, the strictest of
each side's licences; the left one of equals), "and" takes both, "with" keeps its left side and notes
the exception.  These licences give labels.  An expression has one value, however many choices it
offers, so its size is bounded by the text's.

Defined cases: null or empty text has no words, no places, empty labels, score 0; the same phrase
found again counts again; overlapping phrases all count; a tag whose expression does not parse
gives the labels of the identifiers in it; repeated rows are scored alike; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The method's own phrases; labels beside the base ones.
MORE = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "isc license": "isc",
    "creative commons attribution": "cc-by", "creative commons zero": "cc0", "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "boost software license": "bsl", "the unlicense": "unlicense",
    "all rights reserved": "all-rights-reserved", "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
}

TAG = "spdx license identifier"

#: Prefix of an identifier (lower case) to label; the longest prefix wins.
FAMILIES = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "0bsd": "bsd", "mpl": "mpl", "epl": "epl",
    "isc": "isc", "cc0": "cc0", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd",
    "cc-by-nc-sa": "cc-by-nc-sa", "cc-by-nc-nd": "cc-by-nc-nd", "bsl": "bsl", "unlicense": "unlicense", "zlib": "zlib", "artistic": "artistic",
}

_KEEP = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else (b + 32 if 65 <= b <= 90 else 32) for b in range(256))
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    name = identifier.lower()
    fits = [p for p in FAMILIES if name == p or name.startswith((p + "-", p + "+"))]
    return FAMILIES[max(fits, key=len)] if fits else None


def to_postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order; None where it does not parse."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # what may come next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                return None
            stack.append("(")
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


#: How much a family asks for, from nothing (0) to passing on the whole work's source over a network (5); others count as 3.
DEMAND = {
    "cc0": 0, "unlicense": 0, "mit": 1, "bsd": 1, "isc": 1, "zlib": 1, "bsl": 1, "apache": 1, "cc-by": 1, "artistic": 2, "mpl": 2, "epl": 2,
    "lgpl": 3, "cc-by-sa": 3, "cc-by-nc": 4, "cc-by-nd": 4, "cc-by-nc-sa": 4, "cc-by-nc-nd": 4, "gpl": 4, "agpl": 5,
}


def evaluate(expression: str) -> tuple[list[str], bool]:
    """The licences that an expression asks for, sorted, and whether it parses; all its identifiers if not."""
    postfix = to_postfix(expression)
    if postfix is None:
        return sorted({t for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _RANK}), False
    stack: list[tuple[int, dict[str, None]]] = []
    for token in postfix:
        if token not in _RANK:
            stack.append((DEMAND.get(family(token), 3), {token: None}))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            stack.append(left if left[0] <= right[0] else right)
        elif token == "and":
            big, small = (left[1], right[1]) if len(left[1]) >= len(right[1]) else (right[1], left[1])
            big.update(small)
            stack.append((max(left[0], right[0]), big))
        else:
            stack.append((left[0], {f"{x} WITH {e}": None for x in left[1] for e in right[1]}))
    return sorted(stack[0][1]), True


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    phrases = {}
    for kind, table in (("base", BASE), ("more", MORE)):
        for phrase, label in table.items():
            phrases.setdefault(phrase, []).append((kind, label))
    phrases[TAG] = [("tag", "")]
    for phrase, what in phrases.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, tuple(what)))
    a.make_automaton()
    return a


_TAG_LINE = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier\s*:?[ \t]*([^\n\r]*)", re.I)


def tag_expressions(text: str) -> list[str]:
    """The expression behind each identifier tag of a text; comment ends are cut off."""
    return [re.split(r"\*/|-->|[;,\"']", m[1])[0].strip() for m in _TAG_LINE.finditer(text)]


def scan_text(text: str | None, auto) -> dict:
    """All that is known of one text: words, places of phrases, labels, expressions."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()
    out = {"n_words": len(words), "places": [], "base": set(), "labels": set(), "expressions": []}
    if not words:
        return out
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    at, spaces, tagged = 0, 0, False
    for end, (size, what) in auto.iter(line):
        for kind, label in what:
            if kind == "tag":
                tagged = True
                continue
            out["labels"].add(label)
            if kind == "base":
                out["base"].add(label)
                out["places"].append(end + 1 - size)
    places = []
    for begin in sorted(out["places"]):
        spaces += line.count(" ", at, begin)
        at = begin
        places.append(spaces)
    out["places"] = places
    if tagged:
        for expression in tag_expressions(text):
            asked, good = evaluate(expression)
            out["expressions"].append((expression, asked, good))
            out["labels"].update(x for i in asked if (x := family(i.split(" WITH ")[0])))
    return out


def score(found: dict) -> float:
    """0 without a label; a parsed tag is certain, each place of a phrase halves the doubt."""
    if not found["labels"]:
        return 0.0
    if any(good for *_, good in found["expressions"]):
        return 1.0
    return 1.0 - 0.5 ** (1 + len(found["places"]))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def _scan(batches):
    auto = automaton()
    for batch in batches:
        rows = [scan_text(t, auto) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([r["n_words"] for r in rows], pa.int64()),
                pa.array([len(r["places"]) for r in rows], pa.int64()),
                pa.array([r["places"][0] if r["places"] else None for r in rows], pa.int64()),
                pa.array([r["places"][-1] if r["places"] else None for r in rows], pa.int64()),
                pa.array([",".join(sorted(r["base"])) for r in rows], pa.string()),
                pa.array([",".join(sorted(r["labels"] | r["base"])) for r in rows], pa.string()),
                pa.array([score(r) for r in rows], pa.float64()),
                pa.array([" | ".join(x[0] for x in r["expressions"]) for r in rows], pa.string()),
            ],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions"],
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, with places, labels, score and the expressions found."""
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
