"""SentencePiece, token counts, HTML and WARC."""

from __future__ import annotations

import math
import random
import time
import tracemalloc
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpuswright.llm import html, pieces, tokencount, warc
from corpuswright.llm.common import scratch

ODD = ["", "a", " ", "  ", "\n\n", "x  y", " lead", "trail ", "a▁b ▁ ▁▁", "é漢字 漢字" * 40, "\U0001f600 ￾\x00", "tab\there", "word " * 300, "ab" * 5000, "don't  it's\t\n 12ab !!  "]


@pytest.fixture(scope="module")
def coder():
    return pieces.Pieces()


def test_pieces_round_trip(coder):
    ids = coder.encode_all(ODD, list(range(len(ODD))))
    for text, i in zip(ODD, ids, strict=True):
        assert coder.decode(i.tolist()) == text
    again = pieces.Pieces().encode_all(ODD[::-1], list(range(len(ODD)))[::-1])[::-1]
    assert all(a.tolist() == b.tolist() for a, b in zip(ids, again, strict=True))


def test_pieces_have_the_lattice_distribution(coder):
    """Sampled segmentations of one word against all segmentations and their weights."""
    word = "▁thine"
    paths = {}

    def walk(at, ids, weight):
        if at == len(word):
            paths[ids] = weight
            return
        for end in range(at + 1, len(word) + 1):
            if (hit := coder.ids.get(word[at:end])) is not None:
                walk(end, (*ids, hit[0]), weight * hit[1])

    walk(0, (), 1.0)
    whole, n = sum(paths.values()), 20_000
    seen = Counter(tuple(x.tolist()) for x in coder.encode_all(["thine"] * n, list(range(n))))
    assert set(seen) <= set(paths)
    for ids, weight in paths.items():
        p = weight / whole
        assert abs(seen[ids] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 3


def test_pieces_of_long_chunks(coder, monkeypatch):
    """Block by block, a chunk gets the pieces it gets with its whole lattice."""
    draw = random.Random(8)
    texts = ["".join(draw.choice("etaoinshrdlu") for _ in range(n)) for n in (63, 40, 64, 30)] + ["x" * 63, "漢" * 20 + "ab"]
    whole = coder.encode_all(texts, list(range(len(texts))))
    monkeypatch.setattr(pieces, "LONG", 17)
    assert [x.tolist() for x in coder.encode_all(texts, list(range(len(texts))))] == [x.tolist() for x in whole]
    monkeypatch.setattr(pieces, "WINDOW", 50)
    for text in ODD:
        assert coder.decode(coder.encode(text, 1)) == text


def test_pieces_memory_of_a_text_without_cuts(coder, monkeypatch):
    monkeypatch.setattr(pieces, "LONG", 4096)
    text = "".join(random.Random(9).choices("etaoinshrdlu", k=150_000))
    tracemalloc.start()
    ids = coder.encode(text, 5)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert coder.decode(ids) == text
    assert most < 120 * len(text)  # the lattice held whole takes some 480 bytes a character


def test_pieces_cuts_are_safe(coder):
    """No piece goes over a place where the pattern splits."""
    assert not any("▁" in p.lstrip("▁") for p in coder.ids)
    assert not any("\n" in p for p in coder.ids)


def test_pieces_frame(spark):
    df = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 2)], "doc_id long, text string, n_pieces int")
    got = pieces.encoded(df)
    rows = got.collect()
    assert len(rows) == 3
    assert all(r.lossless for r in rows)
    assert rows[0].piece_ids == rows[1].piece_ids
    assert sorted(r.decoded for r in pieces.decoded(got, "piece_ids").collect()) == ["", "a b", "a b"]
    assert pieces.op2(df.where("false")).count() == 0
    assert pieces.op2(df).where("not lossless").count() == 0


def test_counts_after_edits_equal_encoding_again():
    counter, draw = tokencount.Counter(), random.Random(3)
    encode = counter.encoding.encode_ordinary
    for text in ODD * 3:
        ((chars, tokens),) = counter.leaves([text])
        tree = tokencount.Tree(text, chars, tokens, counter)
        assert tree.n_tokens == len(encode(text))
        for _ in range(10):
            n = len(tree.text)
            start = draw.randint(0, n)
            stop = min(n, start + draw.choice([0, 0, 1, 5, 50]))
            insert = draw.choice(["", "z", " ", "  ", "new words", "\n", "it's", "x " * 200, "漢é"])
            want = tree.text[:start] + insert + tree.text[stop:]
            tree.edit(start, stop, insert)
            assert tree.text == want
            assert tree.n_tokens == len(encode(want))


def test_edits_touch_little():
    counter = tokencount.Counter()
    text = "some plain words here " * 5000
    ((chars, tokens),) = counter.leaves([text])
    tree = tokencount.Tree(text, chars, tokens, counter)
    tree.edit(50_000, 50_003, "new")
    assert tree.encoded < 20
    assert tree.renewed <= 2 * tree.half.bit_length()


def test_count_frame_edges(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, "abc def")], "doc_id long, text string")
    got = tokencount.op4(df).collect()
    assert len(got) == 3
    assert [r.n_tokens for r in got if r.doc_id == 1] == [0, 0]
    assert tokencount.op4(df.where("false")).count() == 0


PAGES = {
    "<html><body><header><h1>Site</h1></header><div id='main-menu'><a href=x>A</a></div><div class=content><h2>T</h2><p>One &amp; two<br>three<p>Four</div><div class='comments'><p>hi</p></div><footer>f</footer>": "T\nOne & two three\nFour",
    "<article><header><h1>A</h1><span>by x</span></header><p>B <script>x<p>y</script>c</p><form><p>no</p></form><div class='cookie-notice'>d</div><ul><li>e<li>f</ul></article><article class='comment'>g g g g g g g g</article>": "A\nB c\ne\nf",
    "": "", "plain text <3 & more": "plain text <3 & more", "<p>a</p>\n\n<p>  b\n c </p>": "a\nb c", "<main><p>x</p><aside>y</aside><p>z &nbsp; w</p></main>": "x\nz w", "<div>a<div>b</div>c</div>": "a\nb\nc",
    "<p>open <b>bold<p>next": "open bold\nnext", "<!-- <p>no</p> -->yes<style>p{}</style>": "yes", "<p title='a>b'>t</p><div class=": "t",
}


LONG = "Words of the article that make up most of what this page has to say to anyone who reads it. " * 3
#: Labelled pages: what looks like a name of boilerplate and isn't, and what is.
PAGES |= {
    "<div class='wrap with-sidebar'><article><p>Hello body</p></article></div>": "Hello body",
    "<div class='layout has-banner'><main><p>Hello main</p></main></div>": "Hello main",
    "<div class='sidebar'><article><p>Wrapped in a bad name</p></article></div>": "Wrapped in a bad name",
    "<article><div class='section-header'><h2>Head</h2></div><p class='notice-of-meeting'>Meet</p><div class='social-history'>Past</div><table class='menu-prices'><tr><td>Soup</td></tr></table></article>": "Head\nMeet\nPast\nSoup",
    f"<body><form id=aspnet><div class=banner><p>{LONG}</p></div><div class=banner>ad</div></form></body>": LONG.strip(),
    f"<main><article><p>Part one</p></article><article><p>Part two</p></article></main><div class=comments><p>{LONG}</p></div>": "Part one\nPart two",
    f"<main><h1>Title</h1><p>{LONG}</p><article>teaser</article></main>": f"Title\n{LONG.strip()}\nteaser",
    f"<article><p>{LONG}</p><div class='comment-list'><article>reader</article></div></article><div id='related_posts'><article><a href=x>Other</a></article></div>": LONG.strip(),
    "<article><p>Text <span class='ad-label'>advert</span> goes on</p><div class='share-buttons'>Tweet</div><div class='ad-300x250'>Buy</div></article>": "Text goes on",
}


@pytest.mark.parametrize("page", PAGES)
def test_main_text(page):
    assert "\n".join(html.Page(page).left(set())[0]) == PAGES[page]


class Plain(HTMLParser):
    """Another reader, for pages of plain nested elements: the subtrees as strings, and blocks with all they stand in."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.blocks, self.trees = [[]], [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.stack.append([tag])

    def handle_endtag(self, tag):
        own = self.stack.pop()
        own[0] = "<" + "|".join(own) + ">"
        self.stack[-1].append(own[0])
        self.trees.append(own[0])

    def handle_data(self, data):
        if data.strip():
            self.blocks.append((data.strip(), self.stack[1:]))  # their first items are their strings at the end
            self.stack[-1].append(data.strip())


def test_templates_against_brute_force(spark):
    """Pages read by another parser, subtrees counted by hand, copies of a page once; extra and clashing columns."""
    draw, rows = random.Random(7), []
    notes = [f"<div><p>Notice {k}</p><section>of this site</section></div>" for k in range(6)]
    for k in range(150):
        host, own = draw.choice(["a.org", "b.org", "B.org"]), draw.choice([f"Own {k}", "Common"])
        rows.append((k, f"http://{host}/{k}", f"<body>{draw.choice(notes)}<div><p>{own} text</p><div>{draw.choice(notes)}</div></div></body>", "x", 1))
    seen, pages = {}, {k: (u.split("/")[2].lower(), Plain(h)) for k, u, h, *_ in rows}
    for host, page in pages.values():
        for tree in page.trees:
            seen.setdefault((host, tree), set()).add("\n".join(t for t, _ in page.blocks))
    many = {x for x, found in seen.items() if len(found) >= html.PAGES}
    want = {k: "\n".join(t for t, stands in page.blocks if not any((host, x[0]) in many for x in stands)) for k, (host, page) in pages.items()}
    rows.append((900, "http://c.org/", f"<article><p>{'long page ' * 200_000}</p></article>", None, None))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, mark int")
    got = {r.page_id: r.text for r in html.op7(df).collect()}
    assert len(got.pop(900)) == 1_999_999
    assert got == want
    assert 0 < sum("Notice" not in t for t in got.values())


def test_deep_pages_are_read_in_proportion():
    began = time.time()
    deep = html.Page("<div>x" * 100_000)
    assert len(deep.left(set())[0]) == 100_000
    assert len(deep.hashes()) == 100_000
    html.Page("<p><table><tr><td>" + "<div>y" * 50_000 + "</td>" * 50_000 + "<li>" * 50_000)
    assert time.time() - began < 60
    assert deep.left({deep.elements[50_000].value})[0] == ["x"] * 49_999


def test_main_elements_and_named_ones_go_by_structure():
    text = lambda page: "\n".join(html.Page(page).left(set())[0])
    assert text(f"<main><h1>T</h1><p>Short main.</p></main><article class='teaser'><p>{LONG}</p></article>") == "T\nShort main."
    assert text(f"<body><div class='footer'>{LONG}</div><p>Short.</p></body>") == "Short."
    assert text(f"<body><div class='sidebar'><p>{LONG}</p></div><p>Short.</p></body>") == "Short."
    assert text(f"<div class='content'><p>Short.</p><div class='cookie-banner'>{LONG}</div></div>") == "Short."


def test_menus_and_footers_go_as_templates(spark):
    """On the given tables a tenth of what is around the articles recurs (the rest has other words on each page) and goes
    by recurrence; names settle the rest, and no text goes."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    got = html.op7(pages)
    n = got.agg(F.sum("n_templates").alias("t"), F.sum("n_others").alias("o")).first()
    assert n.t > 0.1 * (n.t + n.o)
    bare = {r.page_id: r.text for r in html.extracted(pages, least=1 << 40).collect()}
    assert {r.page_id: r.text for r in got.collect()} == bare


def test_templates_go_and_passages_stay(spark):
    menu, box = "<div><span>About us and our terms</span></div>", "<div><a href=x>More from us</a></div>"
    bare = [(k, "http://a.org/x", f"<body>{menu}<div><p>Page {k} says word{k}.</p></div></body>") for k in range(30)]
    article = [(100 + k, "http://b.org/x", f"<article><p>Text {k}</p>{box}<p>A passage that all share</p></article>") for k in range(30)]
    copies = [(200 + k, "http://c.org/x", "<body><div><p>The same page again</p></div></body>") for k in range(30)]
    df = spark.createDataFrame(bare + article + copies + [(None, None, None), (None, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.op7(df).collect()}
    assert got[3].text == "Page 3 says word3."
    assert got[103].text == "Text 3\nA passage that all share"
    assert got[203].text == "The same page again"
    assert got[None].text == ""
    assert got[None].n_chars == 0
    assert html.op7(df).count() == 92
    assert html.op7(df.where("false")).count() == 0


def test_templates_without_links_go_from_articles(spark):
    notice = "<div><p>Our terms have changed today</p></div>"
    rows = [(k, "http://d.org/x", f"<article><p>Text {k}</p>{notice}<div><p>Own {k}</p></div><p>A shared passage</p></article>") for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.op7(df).collect()} == {k: f"Text {k}\nOwn {k}\nA shared passage" for k in range(30)}


def test_templates_at_both_ends_of_host_size(spark):
    small = [(k, "http://e.org/x", f"<body><div>Same notice</div><div>Own {k}</div></body>") for k in range(5)]
    large = [(100 + k, "http://f.org/x", f"<body><div>Banner of kind {k % 12}</div><div>Own {k}</div></body>") for k in range(120)]
    df = spark.createDataFrame(small + large + large[:1], "page_id long, url string, html string")
    got = html.op7(df).collect()
    assert sorted((r.page_id, r.text, r.n_templates) for r in got) == sorted((k, f"Own {k if k < 100 else k - 100}", 1) for k in [r[0] for r in small + large + large[:1]])
    few = spark.createDataFrame(small[:4], "page_id long, url string, html string")
    assert {r.n_templates for r in html.op7(few).collect()} == {0}


def test_surt():
    assert warc.surt("http://www.B.a.org:80/x?y=1") == "org,a,b)/x?y=1"
    assert warc.surt("https://u@a.org") == "org,a)/"
    assert warc.surt(None) == ""


def test_warc_round_trip(spark):
    big, other = "é" * 60, "z" * 200
    rows = [(5, "http://a.org/1", big), (3, "http://a.org/2", big), (9, None, big), (4, "http://a.org/1", "small"), (6, "http://a.org/1", "small"), (7, "http://b.org/", None), (None, "http://b.org/", other), (8, "x y\r\nz", other), (8, "x y\r\nz", other)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.op3(spark, df).collect()}
    assert warc.op3(spark, df).count() == 9
    assert (got[3].record_type, got[3].refers_to, got[3].payload_bytes) == ("response", None, 120)
    assert {(got[k].record_type, got[k].refers_to) for k in (5, 9)} == {("revisit", 3)}
    assert {got[k].record_type for k in (4, 6, 7, 8)} == {"response"}
    assert (got[None].record_type, got[None].refers_to) == ("revisit", 8)
    assert got[7].payload_digest == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert warc.op3(spark, df.where("false")).count() == 0


def test_index_finds_over_parts(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    df = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k % 5}", f"page {k}") for k in range(200)], "page_id long, url string, html string")
    folder = scratch(spark, "warc")
    captures = warc.write_archives(df, f"{folder}/w")
    parts = warc.write_index(captures, f"{folder}/i", 4)
    wanted = df.where("page_id % 7 = 0")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.lookup(wanted, parts, f"{folder}/i", f"{folder}/w").collect()}
    assert got == {k: f"page {k}" for k in range(0, 200, 7)}
    missing = spark.createDataFrame([(1, "http://none.org/")], "page_id long, url string")
    assert warc.lookup(missing, parts, f"{folder}/i", f"{folder}/w").count() == 0


def test_counts_with_clashing_columns_and_long_texts(spark):
    long = "word's " * 60_000
    df = spark.createDataFrame([(1, "a b", "x", 5), (2, long, None, None)], "doc_id long, text string, edits string, n_tokens int")
    got = {r.doc_id: r for r in tokencount.op4(df).collect()}
    counter = tokencount.Counter()
    assert got[2].n_tokens == len(counter.encoding.encode_ordinary(long))
    assert got[2].n_reencoded < 100


def test_warc_with_clashing_columns_and_large_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HELD", 1 << 20)
    rows = [(k, f"http://a.org/{k}", chr(97 + k) * 3_000_000, "p", 1) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, first int")
    folder = scratch(spark, "warc")
    got = {r.page_id: bytes(r.payload).decode() for r in warc.round_trip(spark, df, folder).collect()}
    assert got == {r[0]: r[2] for r in rows}
    assert {r.payload_bytes for r in warc.op3(spark, df).collect()} == {3_000_000}
    nulls = spark.createDataFrame([(None, "u", "z" * 100), (None, "v", "z" * 100)], "page_id long, url string, html string")
    assert {r.record_type for r in warc.op3(spark, nulls).collect()} == {"response"}
