"""Exact, substring and near dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from veilspark.llm import components, exact_dedup, near_dedup, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 2**63 - 1


def bag(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def texts(df):
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def brute_exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), BIG if d is None else d, d))
    out = Counter()
    for d, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t)
        keep = min(groups[norm], key=lambda x: x[:2])[2]
        out[d, keep, len(groups[norm]), d == keep, hashlib.sha256(norm.encode()).hexdigest()] += 1
    return out


def brute_substring(rows, w):
    words = [(BIG if d is None else d, WORD.findall(t)) for d, t in rows]
    first = {}
    for d, ws in words:
        for i in range(len(ws) - w + 1):
            k = tuple(ws[i : i + w])
            first[k] = min(first.get(k, BIG), d)
    out = Counter()
    for (d, ws), (doc_id, _) in zip(words, rows, strict=True):
        gone = [False] * len(ws)
        for i in range(len(ws) - w + 1):
            if first[tuple(ws[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        kept = " ".join(x for x, g in zip(ws, gone, strict=True) if not g)
        out[doc_id, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def brute_near(rows, n, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, t in rows:
        ws = WORD.findall(t.translate(lower))
        sets.append((d, {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, sa) in enumerate(sets):
        for b, sb in sets[:i]:
            if a is None or b is None or not sa or not sb:
                continue
            common = len(sa & sb)
            if 100 * common >= percent * (len(sa) + len(sb) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return Counter((d, len(s), None if d is None else find(d), d is None or find(d) == d) for d, s in sets)


EXACT = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
SUB = ("doc_id", "n_words", "n_removed", "kept_sha256")
NEAR = ("doc_id", "n_shingles", "component_id", "kept")


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "small_docs"])
def test_exact(docs, request):
    df = request.getfixturevalue(docs)
    assert bag(exact_dedup.exact_dedup(df), *EXACT) == brute_exact(texts(df))


def test_exact_runs_merge(odd_docs):
    a, b = odd_docs.filter("doc_id < 7"), odd_docs.filter("doc_id >= 7 or doc_id is null")
    merged = exact_dedup.compact(exact_dedup.flush(a), exact_dedup.flush(b))
    whole = exact_dedup.compact(exact_dedup.flush(odd_docs))
    show = lambda df: sorted((r.digest.hex(), r.best.doc_id or -1, r.size) for r in df.collect())
    assert show(merged) == show(whole)


def test_exact_tiers_merge(small_docs):
    """However many flushes and merges there are, the index holds the same entries."""
    show = lambda df: sorted((bytes(r.digest), tuple(r.best), r.size) for r in df.collect())
    whole = exact_dedup.MergeIndex()
    whole.add(small_docs)
    parts = exact_dedup.MergeIndex(fan_in=2)
    for k in range(7):
        parts.add(small_docs.filter(f"doc_id % 7 = {k}"))
    assert [len(t) for t in parts.tiers] == [1, 1, 1]
    assert show(parts.run()) == show(whole.run()) == show(parts.run())


def test_exact_filter(spark, small_docs):
    """The filter lets all repeated digests through, at any size, and turns most others away."""
    run = exact_dedup.compact(exact_dedup.flush(small_docs))
    want = {bytes(r.digest) for r in run.filter("size > 1").collect()}
    for most in (1 << 15, 1 << 17):
        got = {bytes(r.digest) for r in exact_dedup.probe(run, *exact_dedup.repeats_filter(run, len(want), most)).collect()}
        assert want <= got and len(got) < len(want) + run.count() / 4
    assert want


@pytest.mark.parametrize("docs", ["odd_docs", "small_docs"])
def test_exact_digest_collisions(docs, request, monkeypatch):
    """A digest of one byte makes texts collide: byte verification finds it, and the groups are still exact."""
    monkeypatch.setattr(exact_dedup, "digest", lambda norm: exact_dedup.F.unhex(exact_dedup.F.substring(exact_dedup.F.sha2(norm, 256), 1, 2)))
    df = request.getfixturevalue(docs)
    want = Counter()
    for (d, keep, size, kept, _), n in brute_exact(texts(df)).items():
        want[d, keep, size, kept] += n
    assert bag(exact_dedup.exact_dedup(df), *EXACT[:4]) == want


def test_exact_hot_group(spark):
    """Nearly all rows are copies of one text: the group is met by broadcast."""
    rows = [(i, "one text" if i % 10 else f"other {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(exact_dedup.exact_dedup(df), *EXACT) == brute_exact(rows)


@pytest.mark.parametrize(("docs", "w", "block"), [("odd_docs", 50, 1 << 12), ("odd_docs", 4, 1 << 12), ("no_docs", 50, 1 << 20), ("small_docs", 50, 1 << 16), ("small_docs", 50, 1 << 23)])
def test_substring(docs, w, block, request):
    df = request.getfixturevalue(docs)
    assert bag(substring_dedup.substring_dedup(df, w, block), *SUB) == brute_substring(texts(df), w)


def test_substring_levels(small_docs):
    """Few receivers for many blocks: keys and answers travel in several levels."""
    assert bag(substring_dedup.substring_dedup(small_docs, 50, 1 << 14, fan=3), *SUB) == brute_substring(texts(small_docs), 50)


def test_words_that_share_a_name(monkeypatch):
    """Two words under one name are found, in a block and between blocks, and at any level."""
    import numpy as np

    from veilspark.llm import blocks, common

    part = lambda *pairs: [np.array([h for h, _ in pairs], np.uint64), np.array([len(w) for _, w in pairs]), np.frombuffer(b"".join(w for _, w in pairs), np.uint8)]
    one, two, three = part((5, b"ab"), (9, b"c")), part((5, b"ab"), (7, b"d")), part((5, b"xyz"), (9, b"c"))
    for parts, clashes in (([one, two], 0), ([one, two, three], 1)):
        place, folded = substring_dedup._fold("word", parts)
        assert substring_dedup._answer("word", folded)[1][0][1][0].tolist() == [clashes]
        assert len(place) == sum(len(p[0]) for p in parts)
        again = substring_dedup._fold("word", [substring_dedup._cut("word", folded, 0, 2), substring_dedup._cut("word", folded, 2, len(folded[0]))])[1]
        assert all((x == y).all() for x, y in zip(again, folded, strict=True))
    column = common.pa.array(["one two one", "two three four"])
    assert not common.Words(column).distinct()[3]
    assert common.Words(column, seed=1).hash[0] != common.Words(column).hash[0]
    monkeypatch.setattr(common, "word_hashes", lambda raw, a, b, step=0, seed=0: common.mix((b - a).astype("uint64")))
    assert common.Words(column).distinct()[3]
    assert blocks.Exchange(300, 256).levels == 2 and blocks.Exchange(256, 256).levels == 1


def test_words_cost():
    """To verify the words that meet in a bucket costs less than five times what it takes to sort their names."""
    import time

    import numpy as np

    def least(f):
        spent = []
        for _ in range(5):
            began = time.process_time()
            f()
            spent.append(time.process_time() - began)
        return min(spent)

    rng = np.random.default_rng(1)
    names = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    part = [names, np.full(len(names), 5), rng.integers(97, 123, 5 * len(names)).astype(np.uint8)]
    assert least(lambda: substring_dedup._fold("word", [part] * 8)) < 5 * least(lambda: np.argsort(np.concatenate([names] * 8)))


def test_segments_in_parts(small_docs, monkeypatch):
    """However many words are named at a time, segments are the same."""
    block = small_docs.select("doc_id", "text").toArrow()
    block = block.set_column(1, "text", substring_dedup.pa.compute.fill_null(block["text"], ""))
    whole = substring_dedup.Segments(block)
    monkeypatch.setattr(substring_dedup, "PART", 100)
    parts = substring_dedup.Segments(block)
    assert len(whole.start) and all((getattr(whole, x) == getattr(parts, x)).all() for x in ("mark", "start", "size", "row", "key", "key2"))


def test_names_and_words_alike():
    """Names that only their last bits tell apart are still told apart; words are compared to their last byte."""
    import numpy as np

    from veilspark.llm.common import Words, alike, one_of_each

    for names in (np.arange(9, dtype=np.uint64)[::-1] // np.uint64(2), np.zeros(0, np.uint64), np.array([2**64 - 1, 5, 2**64 - 2, 5], np.uint64)):
        at, number = one_of_each(names)
        want, place = np.unique(names, return_inverse=True)
        assert (names[at] == want).all() and (number == place).all()
    for n in (1, 7, 8, 9, 16, 17, 63, 64, 65, 1000):
        for last, same in (("x", True), ("y", False)):
            w = Words(substring_dedup.pa.array([f"{'a' * n}x b {'a' * n}{last} z"]))
            assert alike(w.raw, w.starts, w.ends - w.starts, np.array([0, 1, 0, 3])) is same


@pytest.mark.parametrize("docs", ["odd_docs", "no_docs", "small_docs"])
@pytest.mark.parametrize("n", [4, 5])
def test_near(docs, n, request):
    df = request.getfixturevalue(docs)
    assert bag(near_dedup.near_duplicates(df, n, 80), *NEAR) == brute_near(texts(df), n, 80)


def test_near_chain_and_hot_group(spark):
    """A chain of near copies, and one large group whose members all share buckets."""
    base = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join(base[:i] + [f"z{i}"] + base[i + 1 :])) for i in range(60)]
    rows += [(1000 + i, " ".join([f"q{j}" for j in range(80)] + [f"tail{i}"])) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(near_dedup.near_duplicates(df, 4, 80), *NEAR) == brute_near(rows, 4, 80)


def test_near_rows_that_repeat_ids(spark):
    """One doc_id on two texts: each row is judged by its own text, and no row multiplies."""
    long = [f"w{i}" for i in range(100)]
    other = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(long)), (5, " ".join(long[:-1])), (5, " ".join(other)), (7, " ".join(other[:-1])), (5, " ".join(other)), (None, " ".join(long))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df, 4, 80).collect()
    want = [(1, 97, 1, True), (5, 96, 1, False), (5, 97, 5, True), (7, 96, 5, False), (5, 97, 5, True), (None, 97, None, True)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_near_open_buckets(spark, monkeypatch):
    """Buckets of several components are settled in blocks of few members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for g in range(6):
        mine = base[:60] + [f"g{g}_{i}" for i in range(14)]
        rows += [(100 * g + k, " ".join(mine[:k] + [f"x{g}_{k}"] + mine[k:])) for k in range(0, 60, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(near_dedup.near_duplicates(df, 4, 80), *NEAR) == brute_near(rows, 4, 80)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    assert bag(components.components(links, "a", "b"), "node", "component") == Counter([(i, 0) for i in range(1, 31)] + [(101, 100)])


def test_near_pair_with_low_estimate(spark, monkeypatch):
    """A pair that meets in buckets of two is compared exactly, however low its estimate is."""
    monkeypatch.setattr(near_dedup, "_floor", lambda percent: 2.0)
    words = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "end"])), (3, "some other text of its own here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(near_dedup.near_duplicates(df, 4, 80), *NEAR) == brute_near(rows, 4, 80)
