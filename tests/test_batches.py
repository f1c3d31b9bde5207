"""The array engine against the definitions: notes against their SQL, spans against Python's re and the expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as e
from veilspark.functions import batches as B
from veilspark.functions import generate as G
from veilspark.functions import note_batches
from veilspark.functions import patterns as P
from veilspark.functions import spans as S
from veilspark.operators import deidentify as D
from veilspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["Anna", "Bo", "Smith", "J.", "J", "X. ", "\n", " ", "  ", "\t", ",", ", ", ".", "-", "/", "1", "12", "123", "1234", "12345", "2025", "March", "march", "MAY", "January", " 5, 2024", "3/4/20", "3/4/2020"]
    bits += ["315-555-0100", "(315) 555-0100", "a", "_", "é", "東", "AB123456", "BCBA", "M.A.", "MS CCC-SLP", "OTR/L", "RN", "Behavior Specialist II", "Psychiatrist", "Speech-Language Pathologist", "Session Note"]
    bits += ["12 Elm Street, Town, NY 13204", "Street,", "St", "Oak Main Road,", "\0", "(", ")", "East Aurora", "NY", "Dr, Aa Bb, NY 130", "😀", "The", "1/2/33/44"]
    return ["".join(rng.choice(bits) + (rng.choice(["", " ", ", "]) if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_notes_as_their_sql():
    import duckdb

    con = duckdb.connect()
    con.execute("create table orders as select * from range(1, 1500) t(o_orderkey) union all select unnest([0, -7, 123456789012, 9223372036854775807])")
    for seed in (42, 7):
        want = dict(con.execute(f"select id, text from ({G.notes_sql(G.Dialect('duck', seed))})").fetchall())
        assert len({t.split("\n")[0] for t in want.values()}) == len(G.TEMPLATES)
        assert list(note_batches.note_texts(np.array(list(want), np.int64), seed)) == list(want.values())
    assert list(note_batches.note_texts(np.zeros(0, np.int64))) == []


def test_long_seeds_are_digested_too():
    import hashlib

    (got,) = note_batches.digest_heads([(np.frombuffer(b"s" * 60, np.uint8).reshape(1, -1), b"field")])
    assert got.tolist() == [int(hashlib.md5(b"s" * 60 + b"field").hexdigest()[:8], 16)]


@pytest.mark.parametrize("name", ["notes_generate", "detect_resolved", "eval_strict", "removal_summary", "detection_summary", "similarity_tf", "method_summary", "entity_distribution", "entity_count_compare", "hash_linkage", "sanitize_mask"])
def test_only_keys_are_dealt_out(spark, name):
    """No text crosses an exchange, and each text is made once."""
    plan = e.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("ArrowEvalPython") == 1 and plan.count("Scan parquet") == 1


@pytest.mark.parametrize("ascii_only", [True, False])
def test_patterns_as_re(ascii_only):
    texts = [t for t in random_texts(4000) if not ascii_only or t.isascii()] + [""]
    java = lambda p: p.replace(r"\d", "[0-9]").replace(r"\s", r"[ \t\n\x0b\f\r]")
    for _, p in {x for rules in (P.DETECTION, *P.TRUTH.values(), [("PERSON", P.NAME)]) for x in rules}:
        rule, got, at = re.compile(java(p)), [], 0
        for piece in B.pieces(pa.array(texts)):
            starts, ends = piece.find(p)
            rows = piece.row_of(starts)
            got += zip((rows + at).tolist(), (starts - piece.rows[rows]).tolist(), (ends - piece.rows[rows]).tolist())
            at += piece.n
        assert at == len(texts)
        assert got == [(i, *m.span()) for i, t in enumerate(texts) for m in rule.finditer(t)], p


def test_spans_as_expressions(spark):
    df = spark.createDataFrame(list(enumerate([None, "", *random_texts(300, 2), "ZoéAnna Smith", "x² RN"])), "id int, text string")
    raw = S.in_order(S.name_spans(F.col("text"), "fixed"), *S.pattern_spans(F.col("text"), P.DETECTION))
    truth = {r: S.truth_order(S.in_order(*S.pattern_spans(F.col("text"), P.TRUTH[r]), S.name_spans(F.col("text"), r))) for r in P.TRUTH}
    pairs = [(D.detect_raw(df), raw), (D.detect(df), S.resolve_overlaps(raw))] + [(D.annotate(df, r), truth[r]) for r in P.TRUTH]
    for made, want in pairs:
        rows = lambda d: {r.id: r.entities for r in d.select("id", "entities").collect()}
        assert rows(made) == rows(df.withColumn("entities", want))


def test_pieces_are_bounded(monkeypatch):
    texts = pa.array(random_texts(200, 3))
    whole = pa.concat_arrays([p.detected().to_lists() for p in B.pieces(texts)])
    monkeypatch.setattr(B, "PIECE", 500)
    parts = list(B.pieces(texts))
    assert len(parts) > 20 and max(len(p.text) for p in parts if p.n > 1) <= 501
    assert pa.concat_arrays([p.detected().to_lists() for p in parts]) == whole


def test_every_query_on_no_and_on_missing_keys(spark, tmp_path):
    spark.createDataFrame([(None,)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("notes_generate", "detect_resolved", "sanitize_hash", "removal_by_doc", "eval_by_doc_relaxed", "similarity_tf", "hash_linkage", "entity_distribution", "attach_stored", "eval_stored_strict"):
        assert e.queries()[name](spark, str(tmp_path)).count() == 0
    assert catalogue.notes(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("method", [*S.METHODS, "unknown"])
def test_sanitized_in_one_pass(spark, method):
    df = spark.createDataFrame(list(enumerate([None, "", *random_texts(200, 4)])), "id int, text string")
    rows = lambda d: {r.id: r.sanitized_text for r in d.select("id", "sanitized_text").collect()}
    assert rows(D.sanitize_detected(df, method)) == rows(D.sanitize(D.detect(df), method))


def test_rates_and_similarity_in_one_pass(spark):
    more = ["a(315) 555-0100 x", "x12 Elm Street, Town, NY 13204y", "Anna Smith", "é Anna Smith RN", "?"]
    df = spark.createDataFrame(list(enumerate(["", *random_texts(200, 5), *more])), "id int, text string")
    whole = D.sanitize_all(D.detect(df))
    rates = lambda d: {(r.id, r.method): (r.num_entities, r.removal_rate) for r in d.select("id", "method", "num_entities", "removal_rate").collect()}
    near = lambda d: {(r.id, r.method): r.similarity for r in d.select("id", "method", "similarity").collect()}
    rated = D.rate_detected(df, similarity=True).cache()
    assert rates(rated) == rates(D.rate_detected(df)) == rates(whole)
    assert near(rated.filter("similarity is not null")) == near(D.term_similarity(whole))
    assert {tuple(r) for r in D.method_means(rated).collect()} == {tuple(r) for r in D.method_summary(whole, D.term_similarity(whole)).select("method", "avg_removal_rate", "avg_similarity", "total_documents").collect()}


@pytest.mark.parametrize("mode", ["strict", "relaxed"])
def test_matches_in_one_pass(spark, mode):
    df = spark.createDataFrame(list(enumerate([None, "", *random_texts(300, 6)])), "id int, text string")
    for rules in P.TRUTH:
        both = D.annotate(D.detect(df).withColumnRenamed("entities", "pred"), rules, out="truth")
        assert {tuple(r) for r in D.evaluate_detected(df, rules, mode).collect()} == {tuple(r) for r in D.count_matches(both, mode).collect()}


def test_totals_in_one_pass(spark):
    df = spark.createDataFrame(list(enumerate([None, *random_texts(200, 7)])), "id int, text string")
    truth, pred = (D.explode_spans(d, "id") for d in (D.annotate(df, "fixed"), D.detect(df)))
    bag = lambda d: {tuple(r) for r in d.collect()}
    assert bag(D.kind_totals(df, "fixed")) == bag(D.compare_counts(truth, pred).drop("difference"))
    assert bag(D.detected_distribution(df)) == bag(D.entity_distribution(pred))
    assert bag(D.summarise_texts(df)) == bag(D.summarise(D.detect(df))) and bag(D.summarise_texts(df, "fixed")) == bag(D.summarise(D.annotate(df, "fixed")))
    assert D.detected_distribution(df.limit(0)).count() == D.kind_totals(df.limit(0), "fixed").count() == 0


def test_stored_spans_are_joined_by_name(spark):
    """Equal spans of a list count as often as they stand there; a document without truth has none to find."""
    rng = random.Random(8)
    side = lambda: [(a, a + rng.randint(1, 2), rng.choice("PD"), "x" * 50, 0) for a in (rng.randint(0, 4) for _ in range(rng.randint(0, 9)))]
    rows = [(k, side(), side()) for k in range(200)]
    df = spark.createDataFrame(rows, f"id int, pred array<{S.SPAN}>, truth array<{S.SPAN}>")
    pred, truth = (df.select("id", F.col(c).alias("entities")) for c in ("pred", "truth"))
    want = {tuple(r) for r in D.count_matches(df, "strict").collect()}
    assert {tuple(r) for r in D.evaluate_documents(pred, truth, "strict").collect()} == want
    plan = D.evaluate_documents(pred, truth, "strict")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tokens_of_a_key_on_two_orders(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (1, 2, 3, 3)], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    spans = D.explode_spans(D.detect(catalogue.notes(spark, str(tmp_path))), "id")
    want = spans.withColumn("token", S.token(F.col("span_text"), F.col("type"), "hash")).groupBy("token").agg(F.countDistinct("id").alias("docs"))
    assert {tuple(r) for r in e.queries()["hash_linkage"](spark, str(tmp_path)).collect()} == {tuple(r) for r in want.collect()}


def test_greedy_is_left_to_right():
    rng = random.Random(9)
    for _ in range(200):
        spans = sorted((a, a + rng.randint(1, 5)) for a in (rng.randint(0, 30) for _ in range(rng.randint(0, 15))))
        want, last = [], -1
        for a, b in spans:
            want.append(a >= last)
            last = b if a >= last else last
        assert B.greedy(np.array([a for a, _ in spans], int), np.array([b for _, b in spans], int)).tolist() == want
