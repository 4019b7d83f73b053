"""Archives, page texts, neighbours."""

import gzip
import hashlib
import io
import json
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import by_id

from marginalia.llm import ann, htmltext, warc
from marginalia.llm.tables import fresh_path

PAGES = "page_id long, url string, html string"


def test_round_trip_of_a_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    copies = pages.where("page_id < 9").selectExpr("page_id + 100000 as page_id", "url", "html")
    odd = spark.createDataFrame([(200000, None, None), (200001, "http://x/ y\n", ""), (200002, "u", "short"), (200003, "u", "short"), (200004, "u", "WARC/1.0\r\n\r\nContent-Length: 3\r\n\r\n" * 9)], PAGES)
    everything = pages.select("page_id", "url", "html").union(copies).union(odd)
    first, want = {}, {}
    for r in sorted(everything.collect(), key=lambda r: r["page_id"]):
        b = (r["html"] or "").encode()
        h = hashlib.sha256(b).hexdigest()
        of = first.setdefault(h, r["page_id"]) if len(b) >= 100 else r["page_id"]
        want[r["page_id"]] = (len(b), h, "response" if of == r["page_id"] else "revisit", None if of == r["page_id"] else of)
    got = by_id(warc.roundtrip(everything), "page_id")
    assert {i: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for i, r in got.items()} == want
    assert sum(r["record_type"] == "revisit" for r in got.values()) >= 9
    assert warc.roundtrip(spark.createDataFrame([], PAGES)).isEmpty()


def test_every_record_is_a_member_that_the_sidecar_finds(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}é</p>" * 40) for i in range(30)], PAGES)
    folder = fresh_path(spark, "warc-test")
    archives = warc.write_archives(warc.mark_revisits(pages.coalesce(2)), f"{folder}/crawl")
    done = warc.normalise(archives, f"{folder}/normal")
    seen = set()
    for r in done.collect():
        data = open(r["archive"].removeprefix("file://"), "rb").read()
        at = 0
        for line in open(r["sidecar"].removeprefix("file://")):
            entry = json.loads(line)
            assert entry["offset"] == at
            whole = gzip.decompress(data[at : at + entry["length"]])
            at += entry["length"]
            seen.add(warc.parsed(whole)[0]["warc-record-id"])
        assert at == len(data)
    assert len(seen) == 30
    assert {r["page_id"]: r["payload"] for r in warc.read_archives(done, with_payload=True).collect()} == {i: (f"<p>{i}é</p>" * 40).encode() for i in range(30)}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_records_of_any_gzip_layout(monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    whole = [warc.record(i, "u", b"x\r\n\r\n" * i, "0", None) for i in range(12)]
    joined = b"".join(whole)
    for data in (gzip.compress(joined), b"".join(map(gzip.compress, whole)), gzip.compress(joined[:100]) + gzip.compress(joined[100:])):
        assert list(warc.records(io.BytesIO(data))) == whole
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records(io.BytesIO(gzip.compress(joined[:-30]))))


def text_of(html):
    return htmltext.main_text(html, htmltext.fit())


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>
      <div class="cookie-notice"><p>We use cookies to make this site work for you and others.</p></div><article><h1>The  title &amp; more</h1><p>First <b>bold</b>
      text&nbsp;here, with a <a href=x>link</a>.<br>And on.</p><!-- <p>hidden</p> --><ul><li>item one of a list.<li>item two of it.</ul><p>Last &eacute;&#x1F600;.</p></article>
      <section id="comments"><p>I think that this article is very good indeed, thanks.</p></section><aside><p>Related things to read on this site today.</p></aside><footer>&copy; 2024 All of us.</footer></body></html>"""
    assert text_of(page) == "The title & more\nFirst bold text here, with a link. And on.\nitem one of a list.\nitem two of it.\nLast é😀."


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>/pdivscript!-=\"' &amp;ab\n"), max_size=120))
def test_any_markup_is_read(html):
    text = text_of(html)
    assert text == "\n".join(" ".join(x.split()) for x in text.split("\n"))


def test_cut_is_of_least_cost():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = int(rng.integers(2, 9))
        odds = rng.normal(0, 2, n).round(3).tolist()
        edges = [(i, i + 1, 0.4) for i in range(n - 1)] + [(int(a), int(b), 0.8) for a, b in rng.integers(0, n, (3, 2)) if a != b]

        def cost(labels):
            return sum(abs(x) for x, y in zip(odds, labels, strict=True) if (x > 0) != y) + sum(w for a, b, w in edges if labels[a] != labels[b])

        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert abs(cost(htmltext.minimum_cut(odds, edges)) - best) < 1e-6


def test_classifier_on_pages_not_fitted():
    weights = np.array(htmltext.fit())
    rng = np.random.default_rng(999)
    right = total = 0
    for _ in range(80):
        pieces = htmltext._page(rng)
        page = "<html><body>" + "".join(p for p, _ in pieces) + "</body></html>"
        want = []
        for piece, label in pieces:
            if label == 1:
                want += [t for t, _ in htmltext.blocks(piece)]
        got = htmltext.main_text(page, tuple(weights)).split("\n")
        right += len(set(got) & set(want))
        total += len(set(got) | set(want))
    assert right / total > 0.97


class Article(HTMLParser):
    """Blocks of the article element by the parser of the standard library, adverts, scripts and styles left out."""

    BLOCKS = ("p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "div", "article", "blockquote", "pre", "table", "tr", "td", "th", "section")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.within, self.quiet, self.open, self.now, self.out = 0, 0, [], [], []

    def cut(self):
        text = " ".join("".join(self.now).split())
        self.out += [text] * bool(text)
        self.now = []

    def handle_starttag(self, tag, attributes):
        if tag in self.BLOCKS:
            self.cut()
            hidden = "ad" in (dict(attributes).get("class") or "").split()
            self.open.append((tag, hidden))
            self.quiet += hidden
            self.within += tag == "article"
        elif tag == "br":
            self.handle_data(" ")
        elif tag in ("script", "style"):
            self.quiet += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.quiet -= 1
        if tag in self.BLOCKS:
            self.cut()
            while self.open:
                name, hidden = self.open.pop()
                self.quiet -= hidden
                self.within -= name == "article"
                if name == tag:
                    break

    def handle_data(self, data):
        if self.within and not self.quiet:
            self.now.append(data)


def test_pages_of_a_whole_table_by_another_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        reader = Article()
        reader.feed(r["html"] or "")
        reader.close()
        want[r["page_id"]] = (r["url"], "\n".join(reader.out))
    got = by_id(htmltext.extract(pages), "page_id")
    assert {i: (r["url"], r["text"]) for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and any(t for _, t in want.values())


def test_formulas_and_stand_ins_are_text():
    page = """<html><body><nav><a href=/>Home</a></nav><article><h1>On numbers</h1><p>Whatever is said of it uses <math><mi>x</mi></math> in most of the places.</p>
      <section class="legal related"><p>This part of the article tells what the law has to say of it.</p></section><noscript><p>The picture would be seen here, were it shown.</p></noscript></article></body></html>"""
    assert text_of(page) == "On numbers\nWhatever is said of it uses x in most of the places.\nThis part of the article tells what the law has to say of it.\nThe picture would be seen here, were it shown."


def test_archives_of_odd_rows(spark):
    long = "<p>long enough to be a payload that others may revisit</p>" * 3
    schema = "page_id long, url string, html string, digest string, refers_to long, payload_bytes int, n int"
    rows = [(None, "u", long), (5, None, long), (5, None, long), (7, "u", long), (8, "u", None), (8, "u", None), (9, "u", "x" * 300_000)]
    got = sorted(((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.roundtrip(spark.createDataFrame([(*r, "d", 1, 2, 3) for r in rows], schema)).collect()), key=repr)
    n = len(long)
    assert got == sorted([(0, n, "revisit", 5), (5, n, "response", None), (5, n, "response", None), (7, n, "revisit", 5), (8, 0, "response", None), (8, 0, "response", None), (9, 300_000, "response", None)], key=repr)


def test_pages_as_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>" + "word " * 50000 + ".</p>"), (None, "u", "x")], PAGES).selectExpr("*", "1 as text", "2 as n_chars")
    got = by_id(htmltext.extract(pages), "page_id")
    assert got[1]["text"] == "" and got[2]["n_chars"] == 0 and got[3]["n_chars"] == 250_001 and set(got) == {1, 2, 3, None}
    assert htmltext.extract(spark.createDataFrame([], PAGES)).isEmpty()


def test_recall_over_a_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], float)
    got = {}
    for r in ann.nearest(table).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(axis=1))
        order = [k for k in np.lexsort((ids, d)) if k != q][:10]
        own = got[int(ids[q])]
        assert len(own) == 10 and [s for _, s in own] == sorted(s for _, s in own)
        assert all(abs(s - d[np.flatnonzero(ids == i)[0]]) < 1e-12 for i, s in own)
        hit += len({i for i, _ in own} & set(ids[order].tolist()))
        total += 10
    assert hit / total >= 0.9


def test_vectors_that_take_no_part(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [None, 1.0], 1), (5, [nan, 1.0], 1), (6, [inf, 1.0], 1), (7, [3.0, 4.0, 5.0], 1), (None, [1.0, 0.0], 1), (8, [1.0, 2.0], 1)]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, schema)).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 8, 2.0), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 8, 2.0)]
    assert ann.nearest(spark.createDataFrame([], schema)).isEmpty()


def plain_nearest(rows, k=10, every=100):
    """The k nearest of each query by all distances; rows: (id, vector)."""
    out = {}
    for q in {i for i, _ in rows if i % every == 0}:
        best = {}
        for _, a in (r for r in rows if r[0] == q):
            for i, b in rows:
                if i != q and len(a) == len(b):
                    best[i] = min(best.get(i, np.inf), float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())))
        out[q] = sorted((d, i) for i, d in best.items())[:k]
    return out


@pytest.mark.parametrize("options", [{}, {"part_rows": 40, "fit_rows": 100, "max_cells": 8}])
def test_copies_ties_lengths_repeats_and_clashing_columns(spark, options):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 2.0]) for i in range(210)] + [(i, [1.0, -0.0, 2.0]) for i in range(250, 260)]  # a large group of copies
    centres = rng.normal(size=(12, 3)) * 20
    rows += [(i, (centres[i % 12] + np.round(rng.normal(size=3), 1)).tolist()) for i in range(300, 900)]
    rows += [(900, [1.0, 1.0]), (901, [1.0, 2.0]), (902, [2.0, 1.0]), (902, [2.0, 1.0]), (300, [5.0, 5.0, 5.0]), (300, [5.0, 5.0, 5.0]), (1000, [7.0])]
    table = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], "vec_id long, embedding array<double>, id int, width int, cell int, digest string")
    got = {}
    for r in ann.nearest(table, confidence=0.999999, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    want = {q: found for q, found in plain_nearest(rows).items() if found}
    assert {q: [i for _, i in f] for q, f in got.items()} == {q: [i for _, i in f] for q, f in want.items()}
    assert all(np.allclose([d for d, _ in got[q]], [d for d, _ in f], rtol=1e-14, atol=0) for q, f in want.items())


def test_cells_hold_their_points_and_far_cells_are_left_out():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(500, 4)) + 30 * c for c in rng.normal(size=(8, 4))])
    top = ann.Cells(points[::5], 16)
    cell = top.of(points)
    assert set(cell) == set(range(len(top.low))) and len(top.low) == 16
    assert ((points >= np.array(top.low)[cell]) & (points < np.array(top.high)[cell])).all()
    visits = [set(top.within(p, 4.0).tolist()) for p in points[:200]]
    for p, seen in zip(points[:200], visits, strict=True):
        assert set(cell[((points - p) ** 2).sum(axis=1) <= 4.0]) <= seen
    assert np.mean([len(seen) for seen in visits]) < 6


def test_equal_points_make_one_cell():
    assert len(ann.Cells(np.ones((50, 3)), 8).low) == 1 and ann.Cells(np.empty((0, 3)), 8).of(np.ones((2, 3))).tolist() == [0, 0]


def test_parts_of_an_article_stay_whatever_they_are_called():
    weights = htmltext.fit()
    frame = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav><article><h1>On sorting lists</h1><p>The first paragraph has a good many words in it, as articles do.</p>{}<p>The last paragraph also has more than a few words, and ends.</p></article><div class='ad-slot'>Buy this now.</div><footer>All rights reserved.</footer></body></html>"
    page = lambda part: htmltext.main_text(frame.format(part), weights).split("\n")
    bare = page("")
    assert len(bare) == 3
    text = "This part belongs to the article, and says a thing or two about the matter."
    for attribute in ('class="ad-hoc"', 'class="side-by-side"', 'class="discussion"', 'id="search"', "hidden", 'style="display: none"', 'class="related-work"', 'class="notice-period"'):
        assert page(f"<section {attribute}><p>{text}</p></section>") == [*bare[:2], text, bare[2]], attribute
    links = page('<ul><li><a href="/q">Quick sort explained</a></li><li><a href="/m">Merge sort in depth</a></li></ul>')
    assert links == [*bare[:2], "Quick sort explained", "Merge sort in depth", bare[2]]
    for part in (f'<div class="ad-slot"><p>{text}</p></div>', f'<div class="cookie-banner"><p>{text}</p></div>', f'<section id="comments"><div class="comment"><p>{text}</p></div></section>', '<div class="related-posts"><ul><li><a href="/q">Quick sort explained</a></li></ul></div>', f"<aside><p>{text}</p></aside>"):
        assert page(part) == bare, part


def test_pages_without_markup_are_text():
    weights = htmltext.fit()
    assert htmltext.main_text("one unclosed line &amp; more", weights) == "one unclosed line & more"
    assert htmltext.main_text("a < b", weights) == "a < b" and htmltext.main_text(" \n", weights) == ""
