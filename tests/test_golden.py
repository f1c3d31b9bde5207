"""Sanitizing against a corpus of notes and files sanitized elsewhere, where one is at hand.

GOLDEN_NOTES names a folder of *.txt notes, GOLDEN_SANITIZED one with a folder for each method, each
with notes/sanitized_<note>.  Spans are recovered from the labels of the replaced files.
"""

import os
import re

import pytest

from veilspark.functions import spans as S
from veilspark.operators import deidentify

NOTES, SANITIZED = os.environ.get("GOLDEN_NOTES"), os.environ.get("GOLDEN_SANITIZED")
LABEL = re.compile(r"\[(PERSON|DATE|MEDICAID_ID|PHONE|ADDRESS|CREDENTIAL)\]")


def read(path):
    with open(path, encoding="utf-8") as f:
        return f.read()


def spans_of(note, replaced):
    """The spans of a note, from its text and the text with each span replaced by its label."""
    pieces = LABEL.split(replaced)
    found = re.fullmatch("(.+?)".join(re.escape(x) for x in pieces[::2]), note, re.S)
    return [(found.start(k + 1), found.end(k + 1), kind, found[k + 1], k) for k, kind in enumerate(pieces[1::2])]


def check(spark, notes, want):
    """notes: filename to text; want: (method, filename) to sanitized text.  The number of files compared."""
    rows = [(name, text, spans_of(text, want["replace", name])) for name, text in notes.items() if ("replace", name) in want]
    df = spark.createDataFrame(rows, f"filename string, text string, entities array<{S.SPAN}>")
    got = {(r.method, r.filename): r.sanitized_text for r in deidentify.sanitize_all(df).select("method", "filename", "sanitized_text").collect()}
    both = set(got) & set(want)
    assert not [x for x in both if got[x] != want[x]]
    return len(both)


def test_recovered_spans(spark):
    note = "Anna Smith, BCBA, born 3/4/2011, AB123456"
    want = {
        ("replace", "a"): "[PERSON], [CREDENTIAL], born [DATE], [MEDICAID_ID]",
        ("mask", "a"): "A********h, B**A, born 3******1, A******6",
        ("hybrid", "a"): "[PERSON], BCBA, born 3******1, ad6e5b31",
    }
    import hashlib

    want["hybrid", "a"] = want["hybrid", "a"].replace("ad6e5b31", hashlib.sha256(b"AB123456").hexdigest()[:8])
    assert check(spark, {"a": note}, want) == 3


@pytest.mark.skipif(not (NOTES and SANITIZED), reason="GOLDEN_NOTES and GOLDEN_SANITIZED are not set")
def test_golden_corpus(spark):
    notes = {n: read(os.path.join(NOTES, n)) for n in os.listdir(NOTES) if n.endswith(".txt")}
    want = {}
    for method in S.METHODS:
        folder = os.path.join(SANITIZED, method, "notes")
        want |= {(method, n.removeprefix("sanitized_")): read(os.path.join(folder, n)) for n in os.listdir(folder)}
    n = check(spark, notes, want)
    print(n, "files equal")
    assert n >= len(notes)
