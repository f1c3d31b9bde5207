"""Spans of a text as arrays of structs, by built-in expressions alone.

A span is struct<start int, end int, type string, text string, seq int>: half-open, in code points;
seq is the order of emission and breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

SPAN = "struct<start:int,end:int,type:string,text:string,seq:int>"


def find_spans(text: Column, pattern: str, kind: str, seq: int = 0) -> Column:
    """All matches of a pattern, left to right.

    Matches and the gaps between them partition the text, so one fold over both gives the offsets.
    Texts without a match, the common case, are told by one search and go no further.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("text")))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, x):
        begin = acc["pos"] + x["gap"]
        end = begin + F.length(x["text"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(kind).alias("type"), x["text"].alias("text"), F.lit(seq).alias("seq"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    folded = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), folded).otherwise(F.array().cast(f"array<{SPAN}>"))


def in_order(*arrays: Column) -> Column:
    """The bag union of span arrays; seq becomes the place in it."""
    return F.transform(
        F.concat(*arrays),
        lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"), i.cast("int").alias("seq")),
    )


def pattern_spans(text: Column, registry: list[tuple[str, str]]) -> list[Column]:
    return [find_spans(text, p, kind) for kind, p in registry]


def _is_fixed_name(name: Column) -> Column:
    words = F.split(name, r"\s+")
    low = F.lower(name)
    clear = ~low.rlike("|".join(p.lower() for p in P.FIXED_PHRASES))
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    shape = F.size(words).between(2, 3) & F.forall(words, lambda w: F.replace(F.replace(w, F.lit("."), F.lit("")), F.lit("'"), F.lit("")).rlike("^[A-Za-z]+$") & w.rlike("^[A-Z]"))
    return clear & shape & F.length(first).between(2, 15) & F.length(last).between(2, 20) & ~first.isin(P.FIXED_STARTS)


def _is_legacy_name(name: Column) -> Column:
    return ~name.rlike("|".join(P.LEGACY_SKIP))


def name_spans(text: Column, rules: str = "fixed") -> Column:
    """Person names by rule: candidates by shape, then the filter of that generation."""
    keep = {"fixed": _is_fixed_name, "legacy": _is_legacy_name}[rules]
    return F.filter(find_spans(text, P.NAME, "PERSON"), lambda x: keep(x["text"]))


def gazetteer_spans(text: Column, names: list[str]) -> Column:
    """Person names by a list, whole words, longest first."""
    body = "|".join(sorted({n for n in names if n.isalpha()}, key=lambda n: (-len(n), n)))
    return find_spans(text, rf"\b(?:{body})\b", "PERSON")


def resolve_overlaps(spans: Column) -> Column:
    """Earliest start wins, then the longer span, then the one emitted first."""
    keyed = F.transform(
        spans,
        lambda x: F.struct(x["start"].alias("start"), (-(x["end"] - x["start"])).alias("less"), x["seq"].alias("seq"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text")),
    )
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, x):
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"), x["seq"].alias("seq"))
        kept = F.struct(x["end"].alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))
        return F.when(x["start"] >= acc["pos"], kept).otherwise(acc)

    return F.aggregate(F.array_sort(keyed), zero, step, lambda acc: acc["out"])


def truth_order(spans: Column) -> Column:
    """Stable by start; the first of equal (text, start, end, type) stays; overlaps stay."""
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["seq"].alias("seq"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"))))
    bare = F.array_distinct(F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"))))
    return F.transform(bare, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), x["text"].alias("text"), i.cast("int").alias("seq")))


METHODS = ("replace", "mask", "hash", "hybrid")


def token(text: Column, kind: Column, method: str) -> Column:
    """What stands in for a span's text; an unknown method leaves it."""
    label = F.concat(F.lit("["), kind, F.lit("]"))
    n = F.length(text)
    masked = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(text, F.lit(1))))
    hashed = F.substring(F.sha2(text, 256), 1, 8)
    hybrid = F.when(kind.isin("PERSON", "PHONE", "ADDRESS"), label).when(kind == "DATE", masked).when(kind == "MEDICAID_ID", hashed).otherwise(text)
    return {"replace": label, "mask": masked, "hash": hashed, "hybrid": hybrid}.get(method, text)


def sanitize(text: Column, spans: Column, method: str) -> Column:
    """The text with each of its disjoint, sorted spans rewritten: one pass over gaps and spans."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["end"]))
    parts = F.transform(
        spans,
        lambda x, i: F.concat(
            F.substring(text, F.element_at(ends, i + 1) + 1, x["start"] - F.element_at(ends, i + 1)),
            token(F.substring(text, x["start"] + 1, x["end"] - x["start"]), x["type"], method),
        ),
    )
    tail = F.substring(text, F.element_at(ends, -1) + 1, F.length(text))
    return F.concat(F.array_join(parts, ""), tail)


def removal_rate(spans: Column, sanitized: Column) -> Column:
    """The share of spans whose text is nowhere in the sanitized text; 1 without spans."""
    gone = F.size(F.filter(spans, lambda x: ~F.contains(sanitized, x["text"])))
    return F.when(F.size(spans) == 0, F.lit(1.0)).otherwise(gone.cast("double") / F.size(spans).cast("double"))


def matched(pred: Column, truth: Column, mode: str) -> Column:
    """Greedy one-to-one matches: each prediction in order takes the first free truth that fits."""
    if mode == "strict":
        # fitting is equality there, so any order matches as many: one fold over both sides, sorted together
        side = lambda spans, k: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), F.lit(k).alias("side")))
        zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("").alias("type"), F.lit(0).alias("free"), F.lit(0).alias("hits"))

        def step(acc, x):
            free = F.when((acc["start"] == x["start"]) & (acc["end"] == x["end"]) & (acc["type"] == x["type"]), acc["free"]).otherwise(0)
            hit = (x["side"] == 1) & (free > 0)
            left = F.when(x["side"] == 0, free + 1).when(hit, free - 1).otherwise(0)
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), left.alias("free"), (acc["hits"] + hit.cast("int")).alias("hits"))

        return F.aggregate(F.array_sort(F.concat(side(pred, 0), side(truth, 1))), zero, step, lambda acc: acc["hits"])

    def fits(p, t):
        return (p["type"] == t["type"]) & (p["start"] < t["end"]) & (t["start"] < p["end"])

    places = F.transform(truth, lambda t, i: F.struct(i.cast("int").alias("i"), t["start"].alias("start"), t["end"].alias("end"), t["type"].alias("type")))

    def take(free, p):
        first = F.get(F.filter(free, lambda t: fits(p, t)), F.lit(0))["i"]
        return F.filter(free, lambda t: ~t["i"].eqNullSafe(first))

    return F.size(truth) - F.size(F.aggregate(pred, places, take))
