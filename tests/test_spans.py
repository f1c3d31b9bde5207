"""Every span rule on literals."""

import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import patterns as P
from veilspark.functions import spans as S
from veilspark.operators import deidentify as D


def entities(spark, text, make):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return [(e.type, e.start, e.end, e.text) for e in df.select(make(df).alias("e")).first().e]


def detected(spark, text):
    df = D.detect(spark.createDataFrame([(1, text)], "id int, text string"))
    return [(e.type, e.text) for e in df.first().entities]


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("on 3/15/2025 and 03/15/25, 99/99/2025", [("DATE", "3/15/2025"), ("DATE", "03/15/25"), ("DATE", "99/99/2025")]),
        ("11/14/7", []),
        ("march 5 2024 or March  5,\n2024", [("DATE", "march 5 2024"), ("DATE", "March  5,\n2024")]),
        ("ID AB123456 xAB123456", [("MEDICAID_ID", "AB123456")]),
        ("call (315) 123-4567", []),
        ("a(315) 123-4567", [("PHONE", "(315) 123-4567")]),
        ("212-555-0199", [("PHONE", "212-555-0199")]),
        ("M.A. degree", []),
        ("M.A.b", [("CREDENTIAL", "M.A.")]),
        ("MS, CCC-SLP and MS CCC-SLP, OTR/L RN LCSW BCBA", [("CREDENTIAL", x) for x in ("MS CCC-SLP", "OTR/L", "RN", "LCSW", "BCBA")]),
        ("at 12 Elm Grove Street, East Aurora, NY 14052.", [("ADDRESS", "12 Elm Grove Street, East Aurora, NY 14052")]),
        ("éAnna Smith", []),
        ("Anna\nSmith", [("PERSON", "Anna\nSmith")]),
        (None, []),
        ("", []),
    ],
)
def test_detection(spark, text, found):
    assert detected(spark, text) == found


def test_offsets_agree_with_python(spark):
    text = "東京 Anna Smith, née Maria J. Lopez\nMarch 3, 2024 é 1/2/2024 12-3456 315-555-0100 RN"
    for kind, p in [("PERSON", P.NAME), *P.DETECTION]:
        want = [(kind, m.start(), m.end(), m.group()) for m in re.finditer(p, text)]
        assert entities(spark, text, lambda df, kind=kind, p=p: S.find_spans(F.col("text"), p, kind)) == want


def spans(*items):
    return [(a, b, t, x, k) for k, (a, b, t, x) in enumerate(items)]


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} array<{S.SPAN}>" if isinstance(v, list) else f"{k} string" for k, v in columns.items()))


def test_earliest_start_wins(spark):
    df = one(spark, e=spans((0, 5, "A", "a"), (3, 20, "B", "b"), (5, 7, "C", "c"), (5, 9, "D", "d"), (9, 12, "E", "e")))
    assert [x.type for x in df.select(S.resolve_overlaps(F.col("e")).alias("e")).first().e] == ["A", "D", "E"]
    df = one(spark, e=spans((0, 4, "PERSON", "LCSW"), (0, 4, "CREDENTIAL", "LCSW")))
    assert [x.type for x in df.select(S.resolve_overlaps(F.col("e")).alias("e")).first().e] == ["PERSON"]


@pytest.mark.parametrize(
    ("method", "kind", "text", "out"),
    [
        ("mask", "PERSON", "Aria Gomez", "A********z"), ("mask", "X", "ab", "**"), ("mask", "X", "a", "*"), ("mask", "DATE", "3/15/2025", "3*******5"),
        ("hash", "PERSON", "Aria Gomez", "2cf86adb"), ("hash", "DATE", "12/12/2010", "c2df5a60"), ("hash", "MEDICAID_ID", "BD805316", "1206548b"),
        ("replace", "PHONE", "x", "[PHONE]"), ("hybrid", "PERSON", "x", "[PERSON]"), ("hybrid", "DATE", "3/15/2025", "3*******5"),
        ("hybrid", "MEDICAID_ID", "BD805316", "1206548b"), ("hybrid", "CREDENTIAL", "BCBA", "BCBA"), ("hybrid", "OTHER", "zz", "zz"), ("unknown", "PERSON", "x", "x"),
    ],
)
def test_tokens(spark, method, kind, text, out):
    df = spark.range(1).select(S.token(F.lit(text), F.lit(kind), method).alias("t"))
    assert df.first().t == out


def test_sanitize_and_removal(spark):
    df = one(spark, text="Anna and Bob, Anna", e=spans((0, 4, "PERSON", "Anna"), (9, 12, "PERSON", "Bob")))
    got = df.select(S.sanitize(F.col("text"), F.col("e"), "replace").alias("s"), "e").select("s", S.removal_rate(F.col("e"), F.col("s")).alias("r")).first()
    assert (got.s, got.r) == ("[PERSON] and [PERSON], Anna", 0.5)
    df = one(spark, text="plain", e=[])
    got = df.select(S.sanitize(F.col("text"), F.col("e"), "hash").alias("s"), S.removal_rate(F.col("e"), F.col("text")).alias("r")).first()
    assert (got.s, got.r) == ("plain", 1.0)


def test_strict_and_relaxed(spark):
    pred = spans((0, 10, "P", ""), (8, 12, "P", ""))
    truth = spans((0, 3, "P", ""), (5, 9, "P", ""), (20, 22, "P", ""))
    df = one(spark, pred=pred, truth=truth)
    assert [df.select(S.matched(F.col("pred"), F.col("truth"), m).alias("n")).first().n for m in ("strict", "relaxed")] == [0, 2]
    apart = one(spark, pred=spans((0, 5, "P", "")), truth=spans((5, 9, "P", "")))
    assert apart.select(S.matched(F.col("pred"), F.col("truth"), "relaxed").alias("n")).first().n == 0


def test_truth_only_documents_add_no_misses(spark):
    pred = spark.createDataFrame([(1, spans((0, 4, "P", "Anna")))], f"id int, entities array<{S.SPAN}>")
    truth = spark.createDataFrame([(2, spans((0, 4, "P", "Anna")))], f"id int, entities array<{S.SPAN}>")
    got = D.metrics(D.evaluate_documents(pred, truth, "strict"), "strict").first()
    assert (got.tp, got.fp, got.fn, got.precision, got.recall, got.f1) == (0, 1, 0, 0.0, 0.0, 0.0)
    none = D.metrics(D.evaluate_documents(pred.limit(0), truth, "strict"), "strict").first()
    assert (none.tp, none.fp, none.fn, none.f1) == (0, 0, 0, 0.0)


def test_generations_of_truth(spark):
    df = spark.createDataFrame([(1, "Carey Smith saw a Speech-Language Pathologist; Behavior Specialist here")], "id int, text string")
    kinds = lambda rules: [(e.type, e.text) for e in D.annotate(df, rules).first().entities]
    assert kinds("fixed") == [("PERSON", "Carey Smith"), ("CREDENTIAL", "Speech-Language Pathologist"), ("PERSON", "Language Pathologist"), ("PERSON", "Behavior Specialist")]
    assert kinds("legacy") == [("CREDENTIAL", "Speech-Language Pathologist"), ("PERSON", "Language Pathologist")]


@pytest.mark.parametrize(("value", "good"), [("AB123456", True), ("A1234567", True), ("ab123456", False), ("AB12345", False), (None, False), ("aB123456", False)])
def test_medicaid(spark, value, good):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(D.valid_medicaid(F.col("v")).alias("g")).first().g is good


def test_counts_and_baseline(spark):
    a = spark.createDataFrame([(1, 1, "DATE", 0, 4, "x"), (1, 2, "PERSON", 5, 9, "y")], "id int, rank int, type string, span_start int, span_end int, span_text string")
    assert {tuple(r) for r in D.compare_counts(a, a.filter("type = 'DATE'")).collect()} == {("DATE", 1, 1, 0), ("PERSON", 1, 0, -1)}
    assert D.entity_distribution(a.limit(0)).count() == 0
    m = spark.createDataFrame([("relaxed", 0.6867)], "mode string, recall double")
    assert D.against_baseline(m, 0.683).first().improvement_pct == 0.54


@pytest.mark.parametrize("mode", ["strict", "relaxed"])
def test_matches_as_plain_greedy(spark, mode):
    import random

    rng = random.Random(5)

    def side():
        return [(a, a + rng.randint(1, 4), rng.choice("PD"), "", 0) for a in (rng.randint(0, 9) for _ in range(rng.randint(0, 12)))]

    def greedy(pred, truth):
        free, n = list(truth), 0
        for a, b, kind, *_ in pred:
            fit = [t for t in free if t[2] == kind and ((t[0], t[1]) == (a, b) if mode == "strict" else a < t[1] and t[0] < b)]
            if fit:
                free.remove(fit[0])
                n += 1
        return n

    rows = [(k, side(), side()) for k in range(200)]
    df = spark.createDataFrame(rows, f"id int, pred array<{S.SPAN}>, truth array<{S.SPAN}>")
    got = {r.id: r.n for r in df.select("id", S.matched(F.col("pred"), F.col("truth"), mode).alias("n")).collect()}
    assert got == {k: greedy(p, t) for k, p, t in rows}
