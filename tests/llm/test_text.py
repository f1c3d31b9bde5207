"""Main text, licences, WARC and decontamination."""

import re

import pytest

from veilspark.llm import decontaminate, html_text, licenses, warc


def test_page():
    page = """<html><head><title>T</title><style>x{}</style></head><body><nav><a href=#>Home</a></nav>
    <div class="sidebar">Side words here</div><article><h1>Title &amp; more</h1><p>First   para
    with <b>bold</b> text, long enough to weigh something.</p><p>Second para.</p><script>bad()</script></article>
    <div id="comments"><p>A reader says something quite long here too.</p></div><footer>Foot</footer></body></html>"""
    assert html_text.extract(page) == "Title & more\nFirst para with bold text, long enough to weigh something.\nSecond para."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<nav>x</nav>", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep")])
def test_odd_pages(page, text):
    assert html_text.extract(page) == text


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>é one</p>", 7), (None, None, None, 8), (1, "u", "<p>é one</p>", 9)], "page_id long, url string, html string, text int")
    got = [tuple(r) for r in html_text.extract_pages(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "u", "é one", 5), (None, None, "", 0), (1, "u", "é one", 5)], key=str)
    assert html_text.extract_pages(df.limit(0)).count() == 0


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licences_against_brute_force(spark, small_docs, odd_docs):
    extra = spark.createDataFrame([(900, "GNU general-public LICENSE, mit license mit license; CC BY cc by"), (901, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0")], "doc_id long, text string")
    docs = small_docs.select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text")).unionByName(extra)
    want = sorted(((r.doc_id, *brute_base(r.text)) for r in docs.collect()), key=str)
    got = licenses.scan_licenses(docs)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str) == want
    tagged = got.filter("doc_id = 901").first()
    assert (tagged.labels, tagged.score) == ("gpl,mit", 1.0)
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_expressions():
    assert licenses.to_postfix("a OR b AND c WITH d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert licenses.evaluate("(MIT OR BSD-2-Clause) AND ISC") == (["ISC", "MIT"], True)
    assert licenses.evaluate("GPL-2.0-only OR MIT") == (["MIT"], True)
    assert licenses.evaluate("GPL-2.0-only AND MIT") == (["GPL-2.0-only", "MIT"], True)
    assert licenses.evaluate("(AGPL-3.0 AND MIT) OR GPL-2.0 WITH Classpath-exception-2.0") == (["GPL-2.0 WITH Classpath-exception-2.0"], True)
    many = " AND ".join(f"(A{i} OR B{i})" for i in range(40))  # 2^40 choices, one value
    assert licenses.evaluate(many) == (sorted(f"A{i}" for i in range(40)), True)
    assert licenses.evaluate("MIT OR")[1] is False
    assert licenses.evaluate("")[1] is False


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/", "<p>x</p>"), (2, "http://b/ c", "<p>x</p>"), (3, None, None), (4, "http://d/", ""), (6, "http://e/", "é" * 300), (6, "http://e/", "é" * 300)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, sha string")
    warc.write_archives(df, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert all(r.gap_begin is None for r in got)
    want = {(5, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 3), (6, "response", None)}
    assert {(r.page_id, r.record_type, r.refers_to) for r in got} == want and len(got) == 6
    sizes = {r[0]: (r[2] or "").encode() for r in rows}
    assert all(r.payload_bytes == len(sizes[r.page_id]) and r.payload_digest == warc.base32_sha1(sizes[r.page_id]) for r in got)
    assert all(bytes(r.payload) == sizes[r.page_id] for r in got if r.record_type == "response")


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    parts = [warc.record(i, f"http://x/{i}", f"payload {i}".encode() * 50) for i in range(5)]
    parts = [warc.member(p) if packed else p for p in parts]
    data, begin = bytearray(b"".join(parts)), len(parts[0]) + len(parts[1])
    data[begin + len(parts[2]) // 2] ^= 0xFF
    records, gaps = warc.salvage(bytes(data))
    assert [r["head"]["x-page-id"] for r in records] == ["0", "1", "3", "4"]
    assert [(a, b) for a, b, _ in gaps] == [(begin, begin + len(parts[2]))]
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"junk")[1][0][:2] == (0, 4)
    records, gaps = warc.salvage(b"".join(parts)[:-9])
    assert len(records) == 4 and len(gaps) == 1


def edits_within(item, text, k):
    """Least edits of item against any part of text, by the plain quadratic table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row) <= k


def test_decontamination_against_brute_force(spark):
    item = "The committee decided in the early spring that all nine bridges along the northern canal should be rebuilt before winter."
    other = "Water boils at a lower temperature on high mountains because the pressure of the air is smaller there than at sea level."
    near = item.replace("nine", "ten").replace("rebuilt", "re-built")
    far = item.replace("nine bridges", "several old wooden gates").replace("early spring", "coldest part of autumn").replace("before winter", "when there is money")
    rows = [(1, f"x y z {item} tail"), (2, f"some words {near} and more {other}"), (3, far), (4, None), (5, ""), (6, item.upper().replace(" ", "\n ")), (None, item), (7, "clean text " * 50), (8, item[: len(item) // 2]), (9, "ab")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(10, item), (11, other), (12, None), (13, "ab"), (14, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in rows:
        for i, x in items:
            a, b = decontaminate.fold(x), decontaminate.fold(t)
            if a and b and edits_within(a, b, int(len(a) * decontaminate.RATE) if len(a) >= 20 else 0):
                want.add((d, i))
    for block in (1 << 22, 100):
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, bench, block).collect()} == want
    assert decontaminate.find_contamination(docs, bench.limit(0)).count() == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


ORDINARY = ['<a href="/hidden-gems">x y</a>', '<p title="the hidden cost">x y</p>', '<p aria-hidden="false">x y</p>', '<section id="discussion">x y</section>', '<p id="related-work">x y</p>', '<p class="post-header">x y</p>', '<p class="legal-text">x y</p>', '<p data-role="menu">x y</p>']
DROPPED = ["<p hidden>x y</p>", '<p aria-hidden="true">x y</p>', '<p style="display: none">x y</p>', '<div class="ad">x y</div>', '<div class="share-buttons">x y</div>', '<div class="big related-posts">x y</div>', '<div id="ad-slot-3">x y</div>']


@pytest.mark.parametrize(("part", "kept"), [(p, True) for p in ORDINARY] + [(p, False) for p in DROPPED])
def test_names_inside_articles(part, kept):
    got = html_text.extract(f"<body><article><h1>T</h1><p>before</p>{part}<p>after</p></article></body>")
    assert got.split() == ["T", "before", *(["x", "y"] if kept else []), "after"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<ul><li class="ad">x</ul><p>rest</p>', "rest"),
        ('<ul><li class="ad">x<li>y</ul><p>rest</p>', "y\nrest"),
        ('<ul><li class="ad">x<ul><li>z</ul><li>y</ul><p>rest</p>', "y\nrest"),
        ('<p class="ad">x <b>z<p>rest</p>', "rest"),
        ('<div><div class="ad">x <b>z</div> w</div><p>rest</p>', "w\nrest"),
        ('<p><b><span class="ad">x</b> rest</p>', "rest"),
        ('<table><tr><td class="ad">x<td>y<tr><td>z</table>', "y\nz"),
        ("<html><head><title>T</title><body><p>rest</p></body></html>", "rest"),
        ("<head><meta charset=x><script>a()</script>rest", "rest"),
    ],
)
def test_dropped_elements_end(page, text):
    assert html_text.extract(page) == text


def held(item, text):
    """By brute force: the item, or two thirds of it in one piece, within the edits of that length."""
    m, rate = len(item), decontaminate.RATE
    e = -(-2 * m // 3)
    if edits_within(item, text, int(m * rate)):
        return True
    return e >= decontaminate.EXCERPT_LEAST and any(edits_within(item[i : i + e], text, int(e * rate)) for i in range(m - e + 1))


def test_excerpts_and_short_items_against_brute_force():
    import random

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: decontaminate.fold(" ".join(rng.choice(words) for _ in range(n)))
    items = [prose(n) for n in (16, 22, 14, 18)] + [prose(4)[:n].strip().ljust(n, "x") for n in (12, 13, 14, 15, 16)]
    texts = ["", prose(30)]
    for x in items:
        for share in (1, 0.75, 0.68, 0.6, 0.5):
            size = int(len(x) * share)
            for changes in (0, 1, 2, 5, 9):
                at = rng.randint(0, len(x) - size)
                cut = list(x[at : at + size])
                for _ in range(changes):
                    p = rng.randrange(len(cut))
                    cut[p : p + 1] = rng.choice([[], ["q"], [cut[p], "q"]])
                texts.append(decontaminate.fold(f"{prose(3)} {''.join(cut)} {prose(3)}"))
    index = decontaminate.Index(list(enumerate(items)))
    got = {(r, j) for r, j, _, _ in decontaminate.find_items(texts, index)}
    want = {(r, j) for r, t in enumerate(texts) for j, x in enumerate(items) if t and held(x, t)}
    assert got == want
    whole = {(r, j) for r, t in enumerate(texts) for j, x in enumerate(items) if t and edits_within(x, t, int(len(x) * decontaminate.RATE))}
    assert len(want - whole) > 10 and any(13 <= len(items[j]) <= 15 and items[j] not in texts[r] for r, j in want)


MAIN = [f"Paragraph {i} of the main text tells a good deal about the matter, and it does so at some length." for i in range(6)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # paragraphs beside a small article are not lost to it
        ("<body>" + "".join(f"<p>{x}</p>" for x in MAIN) + "<article><p>Read on.</p></article></body>", "\n".join([*MAIN, "Read on."])),
        ("<body><p>Beside.</p><article>" + "".join(f"<p>{x}</p>" for x in MAIN) + "</article></body>", "\n".join(MAIN)),
        ("<body><div><p>Beside.</p><main>" + "".join(f"<p>{x}</p>" for x in MAIN) + "</main></div></body>", "\n".join(MAIN)),
    ],
)
def test_article_needs_most_of_the_text(page, text):
    assert html_text.extract(page) == text


def test_salvage_of_mixed_archives():
    """Plain records among members, line ends without carriage return, and header bytes that are not UTF-8."""
    parts = [warc.record(i, f"http://x/{i}", b"payload %d" % i) for i in range(4)]
    head, block = parts[1].split(b"\r\n\r\n", 1)
    bare = head.replace(b"\r\n", b"\n") + b"\n\n" + block
    odd = parts[2].replace(b"http://x/2", b"http://x/\xff2")
    data = warc.member(parts[0]) + bare + b"junk" + odd + warc.member(parts[3])
    records, gaps = warc.salvage(data)
    assert [r["head"]["x-page-id"] for r in records] == ["0", "1", "2", "3"]
    begin = len(warc.member(parts[0]) + bare)
    assert [(a, b) for a, b, _ in gaps] == [(begin, begin + 4)]


def test_short_items_are_whole_words():
    index = decontaminate.Index([(1, "ab"), (2, "c++")])
    found = decontaminate.find_items(["cab abc ab.", "tab able", "in c++11 and c++", "xc++"], index)
    assert {(r, j) for r, j, *_ in found} == {(0, 0), (2, 1)}


def test_banded_alignment_against_the_whole_table():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(150):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        at = rng.randint(0, len(text))
        item = list(text[at : at + rng.randint(1, 30)]) or ["a"]
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(item))
            item[p : p + 1] = rng.choice([["c"], [item[p], "b"], ["a"]])
        item, k = "".join(item), rng.randint(0, 4)
        d, _ = decontaminate.banded_distance(decontaminate.codes(item), decontaminate.codes(text), k, at, at)
        assert (d <= k) >= edits_near(item, text, k, at) and (d > k or edits_within(item, text, d))
        whole, _ = decontaminate.banded_distance(decontaminate.codes(item), decontaminate.codes(text), k)
        assert (whole <= k) == edits_within(item, text, k)
        assert isinstance(np.int64(d).item(), int)


def edits_near(item, text, k, at):
    """Whether item stands in text with at most k edits on a path that begins at this place."""
    row = [0 if j == at else 99 for j in range(len(text) + 1)]
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], 99
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row) <= k


def test_salvage_inside_members():
    import os
    import zlib

    parts = [warc.record(i, f"http://x/{i}", os.urandom(400).hex().encode()) for i in range(8)]
    ids = lambda records: [int(r["head"]["x-page-id"]) for r in records]
    inner = bytearray(b"".join(parts))
    begin = sum(map(len, parts[:3]))
    inner[begin + len(parts[3]) // 2] ^= 0xFF
    # one record of an intact member fails; a second member follows
    first, last = warc.member(bytes(inner)), warc.member(warc.record(99, "http://y/", b"z" * 50))
    records, gaps = warc.salvage(first + last)
    assert ids(records) == [0, 1, 2, 4, 5, 6, 7, 99]
    assert [(a, b) for a, b, _ in gaps] == [(0, len(first))] and f"{begin} to {begin + len(parts[3])}" in gaps[0][2]
    # a member damaged part-way keeps its readable beginning
    whole = warc.member(b"".join(parts))
    for broken in (whole[: len(whole) // 2], whole[: len(whole) // 2] + bytes(64) + whole[len(whole) // 2 + 64 :]):
        records, gaps = warc.salvage(broken + last)
        got = ids(records)
        assert got[0] == 0 and got[-1] == 99 and 2 <= len(got) - 1 < 8 and len(gaps) == 1 and gaps[0][:2] == (0, len(broken))
    # wrong checksum: the records' own digests vouch for them, and a record without one is not taken
    bare = parts[1].replace(b"WARC-Block-Digest", b"X-Block-Digest")
    assert bare != parts[1]
    packed = bytearray(warc.member(parts[0] + bare))
    packed[-8] ^= 0xFF
    records, gaps = warc.salvage(bytes(packed))
    assert ids(records) == [0] and len(gaps) == 1
    assert zlib.decompress(whole, 31) == b"".join(parts)
