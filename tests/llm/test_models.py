"""Quality classifier, language model, mixing and the pipeline."""

import math
import re
import time
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import common, interpolation, mixing, quality
from veilspark.llm.common import CLEAN_UP, settle, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(doc_id, n):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % n


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "small_docs"])
def test_lm_counts_and_base(docs, request):
    df = request.getfixturevalue(docs)
    rows = [(r.doc_id, WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + [None]) for r in df.collect()]
    count = Counter(w for d, ws in rows if fold(d, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((d, fold(d, 10) == 0, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in rows)
    got = interpolation.lm_score(df, block_bytes=1 << 14).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 1e-9 for r in got)


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "small_docs"])
@pytest.mark.parametrize("fan", [3, 256])
def test_lm_score_against_a_plain_model(docs, fan, request):
    """The whole model over again, word by word: counts, cells, EM by buckets, and the score; few receivers make several levels."""
    df = request.getfixturevalue(docs)
    rows = [(r.doc_id, [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")), None]) for r in df.collect()]
    got = interpolation.lm_score(df, block_bytes=1 << 13, fan=fan).collect()
    if not rows:
        assert not got
        return
    pairs = lambda ws: zip(["start", *ws[:-1]], ws, strict=True)
    main, tune, both = Counter(), Counter(), Counter()
    uni, uni_main = Counter(), Counter()
    for d, ws in rows:
        f = fold(d, 10)
        if f:
            both.update(pairs(ws))
            uni.update(ws)
            (tune if f == interpolation.TUNE else main).update(pairs(ws))
            if f != interpolation.TUNE:
                uni_main.update(ws)
    before = lambda v, c: c[None] if v == "start" else c[v]
    n_main, n, v = sum(uni_main.values()), sum(uni.values()), len(uni)
    step = interpolation.STEP
    rounded = lambda x: 2 ** -(min(max(round(-math.log2(x) * step), 0), interpolation.CELLS - 2) / step) if x else 0.0
    bucket = lambda c: min(int(math.log2(c)) + 1, interpolation.CONTEXTS - 1) if c else 0

    def em(data):
        w = [1 / 3] * 3
        for _ in range(60):
            share = [1e-3] * 3
            for p, k in data:
                z = sum(a * b for a, b in zip(p, w, strict=True))
                share = [s + k * a * b / z for s, a, b in zip(share, p, w, strict=True)]
            w = [x / (sum(k for _, k in data) + 3e-3) for x in share]
        return w

    held = [(bucket(before(a, uni_main)), (rounded(main[a, b] / before(a, uni_main) if before(a, uni_main) else 0), rounded(uni_main[b] / max(n_main, 1)), 1 / (v + 1)), k) for (a, b), k in tune.items()]
    whole = em([x[1:] for x in held]) if held else [1 / 3] * 3
    weights = {c: em([x[1:] for x in held if x[0] == c]) if any(x[0] == c for x in held) else whole for c in range(interpolation.CONTEXTS)}
    want = []
    for d, ws in rows:
        total = 0.0
        for a, b in pairs(ws):
            c = before(a, uni)
            w = weights[bucket(c)]
            total += math.log10(w[0] * min(both[a, b] / max(c, 1), 1) + w[1] * uni[b] / max(n, 1) + w[2] / (v + 1)) if n else 0.0
        want.append((str(d), len(ws), total))
    have = sorted((str(r.doc_id), r.n_tokens, r.score) for r in got)
    for x, y in zip(have, sorted(want), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], abs=1e-3, rel=1e-3)


def test_lm_leaves_no_levels_on_disk(spark, small_docs):
    """What levels of the exchange hold goes when it is answered; blocks, answers and cells stay."""
    shared = Path(shared_dir(spark).removeprefix("file://")) / "veilspark"
    frames = lambda: {f.name.rsplit("-", 1)[0]: f for f in shared.glob("*") if f not in old}
    old = set(shared.glob("*"))
    interpolation.lm_score(small_docs, block_bytes=1 << 13, fan=3)
    assert sorted(frames()) == ["blocks", "lm-cells", "lm-counts"]


def test_settle_leaves_no_shuffle_files(spark, monkeypatch):
    own = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in own for f in Path(d).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEAN_UP)
    write, seen = common.materialise, []
    monkeypatch.setattr(common, "materialise", lambda *a: seen.append(spark.conf.get(CLEAN_UP)) or write(*a))
    assert settle(spark.range(100000).repartition(4, "id"), "test").count() == 100000
    assert seen == ["true"] and spark.conf.get(CLEAN_UP) == setting
    for _ in range(20):  # Spark removes them behind the job's back
        if not (left := {f for f in files() - before if f.stat().st_size > 10000}):
            return
        time.sleep(0.1)
    raise AssertionError(left)


def test_lm_is_better_than_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in interpolation.lm_score(docs).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_em_finds_the_weights():
    import numpy as np

    cells = np.array([(3 * interpolation.CELLS + 1) * interpolation.CELLS + 0, (3 * interpolation.CELLS + 0) * interpolation.CELLS + 1])
    w = interpolation.learn_weights(cells, np.array([900, 100]), 10**9)
    assert w[3].sum() == pytest.approx(1) and w[3][0] == pytest.approx(0.9, abs=0.01)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_documents(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("held_out and quality is not null").collect()
    good = [r for r in scored if r.quality == 1]
    assert sum((r.predicted == r.quality) for r in scored) / len(scored) > 0.85
    assert sum(r.predicted for r in good) / len(good) > 0.9


def test_quality_features_and_score_against_a_plain_scorer(small_docs):
    """Features and scores over again, one by one, for whole texts of all scripts."""
    import numpy as np

    from veilspark.llm.common import Words

    texts = [r.text for r in small_docs.select("text").limit(40).collect()] + ["", None, "é東 a", "aa aa 東東東東", "\U0001f600x\U0001f600y"]
    column = quality.pa.array(texts)
    model = quality.Model(np.random.default_rng(1).normal(size=quality.TOTAL), 0.25)
    got = model.score(column)
    for text, score in zip(texts, got, strict=True):
        bag = Counter()
        words = WORD.findall(text or "")
        hashes = Words(quality.pa.array([text], quality.pa.string())).hash.tolist()
        assert len(hashes) == len(words)
        bag.update(h % quality.BUCKETS for h in hashes)
        bag[quality.TOTAL - 1] += sum(a == b for a, b in zip(words, words[1:], strict=False))
        for n in quality.GRAMS:
            for i in range(len(text or "") - n + 1):
                key = n * 40503
                for ch in text[i : i + n]:
                    key = ((key ^ int.from_bytes(ch.encode(), "big")) * 2654435761) & 0xFFFFFFFF
                    key ^= key >> 15
                bag[quality.BUCKETS + ((key * 2246822519 & 0xFFFFFFFF) >> 18)] += 1
        z = sum(model.weight[b] * k for b, k in bag.items()) / max(sum(bag.values()), 1) + 0.25
        assert score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


def test_quality_odd_cases(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(odd_docs, none)
    got = quality.score_documents(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and all(r.score == 0.5 and r.predicted == 1 for r in got)
    assert quality.score_documents(no_docs, model).count() == 0
    assert quality.keep_good(odd_docs, model).columns == odd_docs.columns
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (9, 0, 0), (None, 1, 0), (6, None, 0), (12, 0, 1)], "doc_id long, quality int, toxic int")
    again = [quality.fit(odd_docs, labels).score(odd_docs.select("text").toArrow()["text"]).tolist() for _ in range(2)]
    assert again[0] == again[1] and all(0 <= x <= 1 for x in again[0])


def brute_targets(sizes):
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda x: (x is None, (x or "").encode())))}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in sizes if s not in full)
        level = (total - sum(2 * sizes[s] for s in full)) / rest if rest else 0
        over = {s for s in sizes if s not in full and level * weight[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= over


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "small_docs"])
def test_mixing(docs, request):
    df = request.getfixturevalue(docs)
    size, source = Counter(), {}
    for r in df.collect():
        size[r.source] += len(WORD.findall(r.text or ""))
        source.setdefault((r.doc_id, len(WORD.findall(r.text or ""))), []).append(r.source)
    goal = brute_targets(dict(size)) if size else {}
    got = mixing.mix_sources(df).collect()
    assert len(got) == df.count()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(df).collect()))
    taken = Counter()
    for r in got:
        s = source[r.doc_id, r.size][0]
        assert r.source_size == size[s] and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == math.floor(goal[s] + 1e-6) or abs(taken[s] - goal[s]) < 1 for s in goal)


def test_mixing_against_its_sql(spark):
    """Many sources, null ids and a large source, in the order and with the draws of the SQL."""
    import duckdb
    import pandas as pd

    rows = [(i if i % 5 else None, f"word{i} " * (i % 23), "big" if i % 3 else f"s{i % 400}" if i % 7 else None) for i in range(3000)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = Counter((a, b, c, round(d, 6), e) for a, b, c, d, e in duckdb.sql(mixing.SQL).fetchall())
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spread = mixing.mix_sources(df.repartition(7))
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in spread.collect()) == want


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "mixing"]
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    from tests.llm.test_dedup import brute_exact, brute_near, texts

    for name, stage in p.STAGES[:-1]:
        out = p.materialise(stage(spark, docs, sf_dir), "test")
        assert out.columns == docs.columns
        if name == "exact_dedup":
            assert ids(out) == {d for d, _, _, kept, _ in brute_exact(texts(docs)) if kept}
        if name == "near_dedup":
            assert ids(out) == {d for d, _, _, kept in brute_near(texts(docs), 5, 80) if kept}
        assert ids(out) <= ids(docs) and out.count() > 0
        docs = out
    assert ids(p.STAGES[-1][1](spark, docs, sf_dir)) == ids(docs)


def test_pipeline_judges_rows(spark, tmp_path):
    """Null and repeated doc_ids: of equal texts one row stays, and a verdict drops the judged row alone."""
    import corpus_pipeline as p

    item = "The committee decided in the early spring that all nine bridges along the northern canal should be rebuilt before winter."
    long = " ".join(f"w{i}" for i in range(80))
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (4, "other words here"), (None, "lonely"), (None, "lonely"), (7, long), (None, f"{long} tail"), (9, item), (9, "clean text"), (None, f"{item} {long[::-1]}")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    show = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    exact = p.exact_stage(spark, docs, str(tmp_path))
    assert exact.columns == docs.columns
    assert show(exact) == sorted([r for r in rows if r not in ((None, "a b c"), (4, "a b c"), (None, "lonely"))] + [(4, "a b c"), (None, "lonely")], key=str)
    near = p.near_stage(spark, exact, str(tmp_path))
    assert show(near) == [r for r in show(exact) if r != (None, f"{long} tail")]
    assert show(p.decontamination_stage(spark, near, str(tmp_path))) == [r for r in show(near) if item not in r[1]]


def test_quality_scores_do_not_depend_on_the_batch():
    rng = np.random.default_rng(3)
    words = ["tree", "Über", "日本", "x", "!!", "river", "river"]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 5, 40_000, 3, 200_000, 7)] + [None, "y" * (3 * quality.PART + 5)]
    model = quality.Model(rng.normal(size=quality.TOTAL), 0.2)
    whole = model.score(pa.array(texts, pa.string()))
    alone = np.concatenate([model.score(pa.array([t], pa.string())) for t in texts])
    assert whole.tobytes() == alone.tobytes()
    for t, got in zip(texts, whole, strict=True):  # n-grams of a long text, cut nowhere
        bag = Counter(b for bucket, _ in quality.features(pa.array([t], pa.string())) for b in bucket.tolist() if quality.BUCKETS <= b < 2 * quality.BUCKETS)
        assert sum(bag.values()) == sum(max(len(t or "") - n + 1, 0) for n in quality.GRAMS)
        codes, off = quality.characters(*quality.flat_bytes(pa.array([t], pa.string())))
        assert bag == Counter(b for n in quality.GRAMS for b in quality.gram_features(codes, off, n)[0].tolist())
        assert 0 < got < 1
