"""Readers, writers, streams and the generator."""

import json

import pytest

from veilspark.operators import backends, deidentify, generate
from veilspark.sources import readers, writers
from veilspark.streaming import notes as streaming


@pytest.fixture
def folder(tmp_path):
    for name, text in {"b.txt": b"Anna Smith\r\n3/4/2024", "a.txt": "é 315-555-0100".encode(), "c.md": b"no"}.items():
        (tmp_path / name).write_bytes(text)
    return str(tmp_path)


def test_notes(spark, folder):
    got = readers.read_notes(spark, folder).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a.txt", "é 315-555-0100"), (2, "b.txt", "Anna Smith\n3/4/2024")]
    assert readers.read_notes(spark, folder, "hash").select("id").distinct().count() == 2
    with pytest.raises(readers.InputMissing):
        readers.read_notes(spark, folder + "/none")


def test_spans_round_trip(spark, folder, tmp_path):
    found = deidentify.detect(readers.read_notes(spark, folder))
    writers.export_detections(found, str(tmp_path / "d.json"))
    assert [d["id"] for d in json.loads((tmp_path / "d.json").read_text())] == [1, 2]
    writers.write_detections(found, str(tmp_path / "lines"))
    assert spark.read.schema(readers.DETECTIONS).json(str(tmp_path / "lines")).count() == 2
    writers.export_detections(found, str(tmp_path / "a.json"), "doc_id")
    assert readers.read_annotations(spark, str(tmp_path / "a.json")).columns == ["id", "entities"]
    notes = readers.attach(readers.read_notes(spark, folder), readers.read_detections(spark, str(tmp_path / "d.json")).filter("id = 2"))
    out = deidentify.sanitize_all(notes).cache()
    assert {r.sanitized_text for r in out.filter("method = 'replace'").collect()} == {"é 315-555-0100", "[PERSON]\n[DATE]"}
    writers.write_sanitized(out.drop("entities"), str(tmp_path / "san"))
    assert spark.read.parquet(str(tmp_path / "san")).filter("method = 'mask'").count() == 2
    writers.write_text_files(out.filter("method = 'replace'"), str(tmp_path / "files"), text="sanitized_text", prefix="sanitized_")
    assert (tmp_path / "files/sanitized_b.txt").read_text() == "[PERSON]\n[DATE]"
    writers.export_summary(deidentify.removal_summary(out), str(tmp_path / "s.json"), "method")
    assert json.loads((tmp_path / "s.json").read_text())["hash"] == {"avg_removal_rate": 1.0, "total_documents": 2}


def test_relative_folder(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    writers.write_text_files(spark.createDataFrame([("a", "x"), ("b", None)], "filename string, text string"), "below/here")
    assert (tmp_path / "below/here/a").read_text() == "x" and (tmp_path / "below/here/b").read_text() == ""


def test_evaluation_document(spark, tmp_path):
    counts = spark.createDataFrame([(1, 6, 2, 2), (2, 1, 0, 0)], "id long, tp long, fp long, fn long")
    relaxed = deidentify.metrics(counts, "relaxed")
    compared = deidentify.against_baselines(relaxed, {"old": 0.5})
    writers.export_evaluation(deidentify.metrics(counts.limit(0), "strict"), relaxed, compared, str(tmp_path / "e.json"))
    got = json.loads((tmp_path / "e.json").read_text())
    assert got["strict"]["f1"] == 0.0 and got["relaxed"]["recall"] == 0.7778
    assert got["baseline_comparison"] == {"old": {"recall": 0.7778, "baseline": 0.5, "improvement_pct": 55.56}}
    assert writers.report(relaxed.select("mode", "tp", "recall"), "Scores") == "Scores\n===================\nmode     tp  recall\nrelaxed  7   0.7778"


def test_summary_of_nothing(spark):
    df = deidentify.detect(spark.createDataFrame([], "id long, text string"))
    assert tuple(deidentify.summarise(df).first()) == (0, 0, 0.0)


def test_generated_notes_follow_their_rules(spark):
    """Slots of the templates, read back from the texts."""
    from datetime import datetime
    from functools import reduce

    from veilspark.functions import generate as G

    both = [r.asDict() for r in reduce(lambda a, b: a.unionByName(b), [generate.generate_notes(spark, 25, scenario=name) for name in ("maintenance", "environmental_triggers", "post_crisis_recovery")]).collect()]
    day = lambda text: next(datetime.strptime(text, f) for f in ("%m/%d/%Y", "%m/%d/%y", "%B %d, %Y") if _parses(text, f))
    for r in both:
        text = r["text"]
        session = datetime.strptime(text.rsplit(", ", 1)[1], "%m/%d/%Y")
        if r["scenario"] == "maintenance":
            seen = text.split("Watch again ")[1].split(".\nSigned")[0]
            assert 40 <= (day(seen) - session).days <= 60
        if r["scenario"] == "environmental_triggers":
            first, second = text.split(" at ", 1)[1].split(" on ")[0].split(" and ")
            assert first != second and {first, second} <= set(G.PROGRAMS)
        if r["scenario"] == "post_crisis_recovery":
            when = text.split(" after ")[1].split(" (INC-2025-")[0]
            assert text.count(when) >= 4


def _parses(text, form):
    from datetime import datetime

    try:
        return bool(datetime.strptime(text, form))
    except ValueError:
        return False


def test_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("street,zip\nOak,01234\n")
    (tmp_path / "l.txt").write_text(" x \n\ny\n")
    assert readers.read_table(spark, str(tmp_path / "t.csv")).first().zip == "01234"
    assert [r.value for r in readers.read_lines(spark, str(tmp_path / "l.txt")).collect()] == ["x", "", "y"]


def test_stream(spark, folder, tmp_path):
    notes = streaming.stream_notes(spark, folder)
    query = streaming.run_to_parquet(streaming.sanitize_stream(notes, "replace").select("id", "sanitized_text"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    assert {r.sanitized_text for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"é [PHONE]", "[PERSON]\n[DATE]"}
    counts = streaming.type_counts(streaming.stream_notes(spark, folder)).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    assert counts.awaitTermination(120)
    assert {(r.type, r.n) for r in spark.table("counts").collect()} == {("PHONE", 1), ("PERSON", 1), ("DATE", 1)}


def test_generator(spark):
    a, b = (sorted(map(tuple, generate.generate_notes(spark, 40).collect())) for _ in range(2))
    assert a == b and len(a) == 40 and all(t for *_, t in a)
    assert generate.generate_notes(spark, 3, scenario="nothing").filter("text is not null").count() == 0
    ids = [r[0] for r in generate.generate_medicaid_ids(spark, 200).collect()]
    assert len(set(ids)) == 200 and ids == sorted(ids)


def test_missing_backends(spark):
    df = spark.createDataFrame([("x", "y")], "text string, sanitized_text string")
    for library, make in (("spacy", backends.with_model_persons), ("sentence_transformers", backends.embedding_similarity)):
        if not backends.available(library):
            with pytest.raises(backends.BackendMissing):
                make(df)


MODEL = """
import re
from types import SimpleNamespace as N

def load(name):
    def doc(text):
        return N(ents=[N(start_char=m.start(), end_char=m.end(), text=m.group(), label_="ORG" if m.group().isupper() else "PERSON") for m in re.finditer(r"[A-Z]\\w+", text)])
    return N(pipe=lambda texts: map(doc, texts))
"""

ENCODER = """
import numpy as np

class SentenceTransformer:
    def __init__(self, name):
        pass

    def encode(self, texts, normalize_embeddings):
        v = np.array([[1.0 + t.count(c) for c in "abc"] for t in texts])
        return v / np.linalg.norm(v, axis=1, keepdims=True)
"""


def test_model_backends_with_stand_ins(spark, tmp_path):
    """Offsets in code points, the label filter, nulls and similarity, with stand-ins for absent libraries."""
    for library, code in (("spacy", MODEL), ("sentence_transformers", ENCODER)):
        if backends.available(library):
            pytest.skip("the library itself is here")
        (tmp_path / f"{library}.py").write_text(code)
        spark.sparkContext.addPyFile(str(tmp_path / f"{library}.py"))
    df = spark.createDataFrame([(1, "\U0001f600 Anna met NASA and Bo"), (2, None), (3, "")], "id int, text string")
    got = {r.id: r.persons for r in backends.with_model_persons(df).collect()}
    assert [tuple(x) for x in got[1]] == [(2, 6, "PERSON", "Anna", 0), (20, 22, "PERSON", "Bo", 2)] and got[2] == got[3] == []
    found = deidentify.detect(backends.with_model_persons(df), person="persons").filter("id = 1").first().entities
    assert [(x.type, x.text) for x in found] == [("PERSON", "Anna"), ("PERSON", "Bo")]
    pairs = spark.createDataFrame([(1, "aab", "aab"), (2, "aaa", "bbb"), (3, None, "")], "id int, text string, sanitized_text string")
    score = {r.id: r.similarity_score for r in backends.embedding_similarity(pairs).collect()}
    assert score[1] == pytest.approx(1) and score[2] == pytest.approx(9 / 18) and score[3] == pytest.approx(1)
