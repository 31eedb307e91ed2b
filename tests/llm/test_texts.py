"""Tokenisation, extraction, decontamination and archives."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import common, decontam, html_density, warc
from factloom.llm import wordarrays as wa


@pytest.mark.parametrize("chunk", [7, 50, 1 << 17])
def test_words_equal_regex(monkeypatch, chunk):
    monkeypatch.setattr(wa, "_CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    for _ in range(30):
        docs = [None if rng.random() < 0.1 else "".join(rng.choice(list("aB é 1.\n\t"), rng.integers(0, 120))) for _ in range(8)] + ["x" * int(rng.integers(0, 99))]
        for table, pattern in ((wa.SPACED, rb"[^\x20\x09-\x0D]+"), (wa.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            w = wa.words_of(pa.array(docs, pa.string()), table)
            got = [[table[w.data[w.starts[k] : w.ends[k]]].tobytes() for k in range(w.first[i], w.first[i + 1])] for i in range(len(docs))]
            assert got == [re.findall(pattern, (d or "").encode().lower()) for d in docs]


def test_blocks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 50, 0, 500, 1)] + [None])], names=["t"])
    parts = list(common.blocks(batch, "t", 20))
    assert pa.Table.from_batches(parts).column("t").to_pylist() == batch.column(0).to_pylist() and len(parts) > 2
    assert [b.num_rows for b in common.blocks(batch.slice(0, 0), "t")] == [0]


PAGES = {
    "plain &lt;text": "plain <text",
    "": "",
    "<html><body></body></html>": "",
    "<nav><a>x</a></nav><article><h1>T &amp; U</h1><p>One  <b>t</b>wo&nbsp;three.<br>Four<p>Five</article><footer>f</footer>": "T & U One two three. Four Five",
    "<body><div class='ad'>buy<p>now</div><div><p>The text itself is here, some words.</p></div><div id='comments'><p>very long reader comment, longer than the text itself, on and on</p></div>": "The text itself is here, some words.",
    "<article>a<script>var x='</p>';</script><!-- c -->b<style>p{}</style></article>": "ab",
    "<body><form><p>Subscribe to us please now</p></form><main><ul><li>one thing<li>two things</ul></main>": "one thing two things",
    "<div><aside><p>never closed</div><article>body text</article>": "body text",
    "<article><p>cut off here &am": "cut off here &am",
}


@pytest.mark.parametrize("source", PAGES)
def test_main_text(source):
    assert html_density.extract(source) == PAGES[source]


ARTICLE = "A long sentence of the article itself. " * 12
PLAIN = " ".join(ARTICLE.split())


def test_html_names_do_not_decide_alone():
    article = f"<p>{ARTICLE}</p>"
    note = '<div class="cookie-notice">We use cookies.</div>'
    comments = '<div id="comments">' + '<div class="comment">Nice one, thanks for it.</div>' * 40 + "</div>"
    for page in (
        f'<body><div class="site has-sidebar">{article}{note}</div></body>',
        f'<body><div id="content" class="no-comments">{article}</div></body>',
        f'<body><form action="/"><div class="with-menu">{article}</div>{note}</form></body>',
        f'<body><span class="ad-free"><span>{article}</span></span></body>',
        f'<body><div class="has-sidebar">{article}{comments}</div></body>',
        f'<body><div class="sidebar">{article}</div><div>short</div></body>',
        f'<body><div class="comments ad">{article}</div></body>',
    ):
        assert html_density.extract(page) == PLAIN, page
    for beside in (note, comments, "<form>Search here</form>", '<div hidden class="popup">' + article * 3 + "</div>"):
        assert html_density.extract(f"<body><div>{article}</div>{beside}</body>") == PLAIN


def test_html_article_is_kept_whole():
    page = """<body><nav><a href="/">Home</a></nav><article><div class="article-header"><h1>The title</h1></div><p class="share-price">Share price 12.3</p>
      <p>Some plain words here.</p><ul><li><a href="1">one</a><li><a href="2">two</a></ul><p>End.</p></article><div>Buy now</div></body>"""
    assert html_density.extract(page) == "The title Share price 12.3 Some plain words here. one two End."
    assert html_density.extract(page.replace("article>", "div>").replace("Some plain", ARTICLE)).startswith("The title Share price")
    nested = f"<body><main><h1>T</h1><article><p>{ARTICLE}</p><article><p>{ARTICLE * 2}</p></article></article></main></body>"
    assert html_density.extract(nested) == f"T {PLAIN}"


def test_html_density_rejects_what_no_name_marks(monkeypatch):
    page = f"""<body><div><a href="1">Home</a><a href="2">About us</a></div><h1>Title</h1><div><p>{ARTICLE}</p><p>short</p></div>
      <div>Cookies are used here, accept.</div><div><p>Buy this.</p><a href="3">now</a></div></body>"""
    assert html_density.extract(page) == f"Title {PLAIN} short"
    monkeypatch.setattr(html_density, "select", lambda nodes: setattr(nodes[0], "content", True))
    assert html_density.extract(page) == f"Home About us Title {PLAIN} short Cookies are used here, accept. Buy this. now".replace("Home About", "HomeAbout")


def _articles(name):
    import duckdb

    import html as h

    out = []
    for (source,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall():
        inner = re.sub("<footer>.*", "", re.search("<article>(.*?)(</article>|$)", source, re.S)[1], flags=re.S)
        inner = re.sub("<[^>]*>", "", re.sub("</?(p|h1|br)[^>]*>", " ", inner))
        out.append((source.replace("<article>", f"<{name}>").replace("</article>", f"</{name}>"), " ".join(h.unescape(inner).split())))
    return out


@pytest.mark.parametrize(("name", "least"), [("article", 250), ("div", 249)])
def test_density_alone_finds_articles_and_its_lack_none(monkeypatch, name, least):
    """Without names of classes, and then without selection."""
    monkeypatch.setattr(html_density, "_named", lambda value: 0)
    pages = _articles(name)
    assert sum(html_density.extract(p) == t for p, t in pages) >= least and len(pages) == 250
    monkeypatch.setattr(html_density, "select", lambda nodes: setattr(nodes[0], "content", True))
    assert sum(html_density.extract(p) == t for p, t in pages) == 0


SEMANTIC = "nav aside footer header article form main section".split()


def test_density_finds_articles_where_no_tag_or_name_tells():
    """All semantic elements as div, and no class, id or role: what is left to decide are densities."""
    marks, names = re.compile(rf"<(/?)(?:{'|'.join(SEMANTIC)})\b"), re.compile(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
    pages = [(names.sub("", marks.sub(r"<\1div", p)), t) for p, t in _articles("article")]
    assert sum(html_density.extract(p) == t for p, t in pages) >= 240 and len(pages) == 250


def test_density_sums_tell_sections_from_notices():
    section = lambda n: "<div>" + f"<p>{ARTICLE}</p>" * n + "</div>"
    note = "<div>All rights are reserved by us, and by those who wrote this page.</div>"
    text = lambda n: " ".join([PLAIN] * n)
    assert html_density.extract(f"<body>{section(3)}{note}{section(2)}{note}</body>") == text(5)
    assert html_density.extract(f"<body>{note}{section(2)}{note}</body>") == text(2)


def _shape(node):
    """(C, T, LC, LT) of a subtree by recursion."""
    c = t = lc = lt = 0
    for x in node.children:
        if isinstance(x, str):
            c += len(re.sub(r"\s", "", x))
        else:
            got = _shape(x)
            c, t, lc, lt = c + got[0], t + got[1] + 1, lc + got[2], lt + got[3] + (x.tag == "a")
    return c, t, c if node.tag == "a" else lc, lt


def test_densities_and_the_core_against_brute_force():
    import math

    rng = np.random.default_rng(1)

    def tree(depth):
        kids = [tree(depth - 1) if rng.random() < 0.7 and depth else "w" * int(rng.integers(1, 60)) for _ in range(rng.integers(1, 4))]
        name = str(rng.choice(["div", "section", "a", "td"]))
        return f"<{name}>{''.join(kids)}</{name}>"

    for _ in range(60):
        nodes = html_density.count(html_density.parse(f"<x>{tree(3)}{tree(3)}</x>"))
        body = nodes[0]
        core = html_density.measure(nodes)
        bc, _, blc, _ = _shape(body)
        density, least, total = {}, {}, {}
        for n in nodes:
            c, t, lc, lt = _shape(n)
            base = math.log(c / max(c - lc, 1) * lc + blc / bc * c + math.e) if c else 1
            density[n] = c / max(t, 1) * math.log(max(1, c / max(lc, 1) * max(t, 1) / max(lt, 1))) / max(1, math.log(base)) if c else 0
            path = [n]
            while path[-1] is not body:
                path.append(path[-1].parent)
            least[n] = min(density[x] for x in path)
        for n in nodes:
            own = len("".join(c for c in n.children if isinstance(c, str)))
            base = math.log((own / 1 * own if n.tag == "a" else 0) + blc / bc * own + math.e)
            mine = own * math.log(max(1, own / max(own if n.tag == "a" else 1, 1))) / max(1, math.log(base)) if own else 0
            parts = [density[c] for c in n.children if not isinstance(c, str)] + ([mine] if own or not n.nodes() else [])
            total[n] = sum(x for x in parts if x >= least[n])
            assert abs(n.density - density[n]) < 1e-6 * (1 + density[n]) and abs(n.least - least[n]) < 1e-6 * (1 + least[n]) and abs(n.total - total[n]) < 1e-6 * (1 + total[n])
        assert abs(core.total - max(total.values())) < 1e-6 * (1 + core.total)


def test_damaged_and_long_pages():
    rng = np.random.default_rng(2)
    bits = ["<div>", "</div>", "<p>", "</p>", "<article>", "</article>", "<a href='x'>", "</a>", "<h1>", "<ul><li>", "</ul>", "<nav>", "</nav>", "<form>", "text ", "more words ", "&lt;", "<", ">", "<br>", "<!--", "-->", "<div class='ad'>", "<body>", "</body>", "<table><tr><td>", "</table>", "<span>"]
    for _ in range(400):
        got = html_density.extract("".join(rng.choice(bits, rng.integers(0, 40))))
        assert got == " ".join(got.split())
    words = "word " * 60
    assert html_density.extract(f"<article>{f'<p>{words}</p>' * 3000}</article>") == " ".join((words * 3000).split())


def test_deep_page_needs_no_recursion():
    assert html_density.extract("<div>" * 5000 + "text" + "</div>" * 5000) == "text"


@pytest.mark.parametrize("opening", ["<div>", "<div><nav>", "<ul><li>", "<article>", "<p><button>", "<table><tr><td>", "<div></b></section>"])
def test_deep_pages_take_linear_time(opening):
    """Sixteen times the depth takes far less than sixteen times sixteen the time."""
    import time

    def seconds(depth):
        began = time.process_time()
        html_density.extract(opening * depth + "text")
        return time.process_time() - began

    seconds(100)
    assert seconds(48_000) < 64 * max(seconds(3_000), 0.01)


def test_extract_pages_nulls_extras_and_empty(spark):
    df = spark.createDataFrame([(1, "u", None, 7), (2, None, "<p>a</p>", 8), (2, None, "<p>a</p>", 8)], "page_id long, url string, html string, text int")
    rows = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_density.extract_pages(df).collect() if r.url) + sorted((r.page_id, r.text, r.n_chars) for r in html_density.extract_pages(df).collect() if not r.url)
    assert rows == [(1, "u", "", 0), (2, "a", 1), (2, "a", 1)]
    assert html_density.extract_pages(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(3, "u", "<p>b</p>", 1, "i")], "page_id long, url string, html string, n_chars int, id string")
    assert [tuple(r) for r in html_density.extract_pages(clash).collect()] == [(3, "u", "b", 1)]


def _brute(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            y = words(x)
            k = min(n, len(y))
            for a in range(len(y) - k + 1 if k else 0):
                for b in range(len(w) - k + 1):
                    if w[b : b + k] == y[a : a + k]:
                        hit.update(range(b, b + k))
                        found.add(i)
        out.append((d, len(w), len(hit), len(found)))
    return sorted(out, key=str)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice(["a", "b", "C.", "é", "dd"], n))
    items = [(1, word(14)), (2, "a b"), (3, None), (4, "..."), (5, word(12)), (5, word(11)), (6, "a b")]
    docs = [(i, f"{word(9)} {items[int(rng.choice([0, 4, 5]))][1].upper()} {word(int(rng.integers(0, 30)))}") for i in range(20)] + [(30, None), (31, ""), (32, "A, b"), (32, "A, b"), (None, "a b")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (32 << 20, 40):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.report(d, b, block_bytes=block).collect()), key=str)
        assert got == _brute(docs, items)
    assert decontam.report(d, b.limit(0)).where("contaminated").count() == 0
    assert decontam.report(d.limit(0), b).count() == 0
    left = decontam.clean(d, b.where("item_id in (1, 5)"), drop_share=2.0)
    assert left.count() == d.count() and left.columns == d.columns and decontam.report(left, b.where("item_id in (1, 5)")).where("contaminated").count() == 0
    untouched = {r.doc_id: r.text for r in left.where("doc_id in (30, 31, 32)").collect()}
    assert untouched[30] is None and untouched[32] == "A, b"


def test_warc_round_trip(spark):
    rows = [(1, "http://a/b", "x\r\n\r\nWARC/1.1\r\n", 0), (2, None, "x\r\n\r\nWARC/1.1\r\n", 0), (3, "http://a\r\nx", None, 0), (4, "q", "", 0), (5, "u", "é", 0), (5, "u", "é", 0), (6, "u", "é" * 100_000, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, response int")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(df).collect() if r.refers_to) + sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc.round_trip(df).collect() if not r.refers_to)
    assert got == [(2, 15, "revisit", 1), (4, 0, "revisit", 3), (1, 15, "response"), (3, 0, "response"), (5, 2, "response"), (5, 2, "response"), (6, 200_000, "response")]
    assert warc.round_trip(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, "x" * 9), (None, "u", "x" * 9), (None, "v", "only"), (7, "u", "x" * 9), (8, "u", "x" * 9), (8, "w", "x" * 9)], "page_id long, url string, html string")
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(odd).collect()), key=str) == [
        (7, 9, "response", None), (8, 9, "revisit", 7), (8, 9, "revisit", 7), (None, 4, "response", None), (None, 9, "revisit", 7), (None, 9, "revisit", 7)]
    kinds = {r.record_type for r in warc.round_trip(df, revisit_from=3).where("page_id = 4").collect()}
    assert kinds == {"response"}


def test_warc_transactions_are_nested(spark):
    df = spark.createDataFrame([(9, "http://h/p", "body")], "page_id long, url string, html string")
    path = warc.write(df, common.shared_path(spark, "w"))
    row = warc.assemble(warc.read_records(spark, path)).first()
    assert row.request.block.startswith(b"GET /p HTTP/1.1\r\nHost: h") and row.metadata.block.startswith(b"captureId: 9") and row.response.payload == b"body"
    assert row.response.payload_digest == row.response.declared_digest


def test_warc_parser_survives_damage():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    assert len(list(warc.parse(good + good[:-8]))) == 1
    assert len(list(warc.parse(good.replace(b"Content-Length: 2", b"Content-Length: x") + good))) == 1
    assert list(warc.parse(b"")) == []
