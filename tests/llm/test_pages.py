"""Web pages: extraction by wrappers, archives and their round trip."""

import collections

import pytest

from rxatlas.llm import op8_html, op9_warc

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home"><header>Site</header>
<nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad --><div class="ad">AD</div><div id="cookieNotice">We use</div>
<article><h1>T &amp; x</h1><p>Hello <b>bold</b> w&ouml;rld&nbsp;!<br>two<p>Unclosed   para <a href=q>link</a>
<ul><li>one<li>two</ul><div class="share-buttons">Share</div><aside>Side</aside><form><label>Mail</label><input></form><p>1 < 2 &lt; 3&#8211;&#x41;</p>
<blockquote>Quote</blockquote>tail</article><section id="comments"><article class="comment"><p>Reader says</p></article></section><footer>&copy; foo</footer></body></html>"""
TEXT = "T & x\nHello bold wörld ! two\nUnclosed para link\none\ntwo\n1 < 2 < 3–A\nQuote\ntail"


def test_main_text(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", None), (3, None, ""), (4, "odd", "plain &amp; text"), (5, "http://b.example", "<p>a<p>b<div>c<p>d</div>e<ul><li><a>menu</a></ul>"), (1, "http://a.example/1", PAGE)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "'h' AS host", "1 AS id", "'t' AS text")
    got = sorted((r.page_id, r.text) for r in op8_html.main_text(frame).collect())
    assert got == [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, "plain & text"), (5, "a\nb\nc\nd\ne")]


def plain_main_text(pages):
    """Every text of a page in order; without an article, what stands at the same place on at least half of a host's distinct pages goes."""
    import re

    out = {}
    for i, source in pages:
        inside = re.search("<article>(.*?)</article>", source, re.S)
        out[i] = [t for t in re.findall(r"<(?:p|h1|h2|div)>([^<]+)", inside.group(1) if inside else source)]
    return out


@pytest.mark.parametrize("n", [1, 2, 9, 10])
def test_text_of_an_article_stays_whatever_recurs(spark, n):
    pages = [(i, f"<div><p>Menu of the site</p></div><article><h1>Cake {i}</h1><h2>Ingredients</h2><p>Text {i}.</p><p>Follow us today</p></article>") for i in range(n)]
    rows = [(i, f"http://a.example/{i}", p) for i, p in pages]
    got = {r.page_id: r.text for r in op8_html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: "\n".join(t) for i, t in plain_main_text(pages).items()}


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10])
def test_constants_of_hosts_without_articles(spark, n):
    long_text = "This notice stands on every page of the site and is longer than twenty words by far, as it goes on and on about what the site does with you."
    pages = [(i, f"<div>Site menu</div><div><p>Text {i} of the page.</p></div><div>{long_text}</div>") for i in range(n)]
    rows = [(i, f"http://a.example/{i}", p) for i, p in pages] + [(n, "http://a.example/0", pages[0][1]), (n + 1, "http://b.example/", "<p>Alone</p>")]
    got = {r.page_id: r.text for r in op8_html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    whole = plain_main_text(pages)
    for i in range(n):
        assert got[i] == (f"Text {i} of the page." if n >= op8_html.TEMPLATE_PAGES else "\n".join(whole[i]))
    assert got[n] == got[0] and got[n + 1] == "Alone"


def test_deep_and_wide_pages(spark):
    deep = "<div>" * 5000 + "<p>Deep text</p>" + "<div>" * 300 + "unclosed"
    wide = "".join(f"<p>a{i}<div>b{i}</div><h2>c{i}</h2>" for i in range(4000))
    inside = "<span class='x'><section>" * 2000 + "<article><h1>T</h1><p>Text</p></article>"
    rows = [(1, "http://a.example", deep), (2, "http://a.example", wide), (3, "http://a.example", inside), (4, "http://b.example", deep + "<p>more</p>")]
    got = {r.page_id: r.text for r in op8_html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == "Deep text\nunclosed" and got[3] == "T\nText" and got[4] == "Deep text\nunclosed\nmore"
    assert got[2] == "\n".join(f"a{i}\nb{i}\nc{i}" for i in range(4000))


def test_empty_pages_table(spark):
    frame = spark.createDataFrame([], "page_id int, url string, html string")
    assert op8_html.main_text(frame).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    copy = "<article><h1>The copied page</h1><p>Copied text.</p></article>"
    rows = [(i, f"http://a.example/{i}", copy) for i in range(30)]
    rows += [(i, f"http://a.example/{i}", f"<article><h1>Title {i}</h1><p>Text of {i}.</p>{'<h2>Results</h2>' * (i % 5 > 0)}</article>") for i in range(30, 50)]
    rows += [(i, f"http://b.example/{i}", "<div><h1>Plain copy</h1><p>Short.</p></div>") for i in range(50, 80)]
    got = {r.page_id: r.text for r in op8_html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert all(got[i] == "The copied page\nCopied text." for i in range(30)) and all(got[i] == "Plain copy\nShort." for i in range(50, 80))
    assert got[31] == "Title 31\nText of 31.\nResults"


def test_marks_do_not_hide_the_article(spark):
    article = "<article><h1>Title</h1><p>The whole text of this page.</p><div class='share-buttons'>Share</div></article>"
    pages = [
        f"<div class='layout has-sidebar'>{article}<div class='sidebar'>Side</div></div>", f"<div class='page-with-header'>{article}</div>", f"<div id='noSidebar'>{article}</div>",
        article.replace("<article>", "<article class='post comment-enabled'>"), f"<div class='widget'>{article}</div><div class='ad'>AD</div>",
        f"<div><p>Title</p><p>The whole text of this page.</p></div><section id='comments'>{'<article class=comment><p>Reader</p></article>' * 2}</section>"]
    rows = [(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)]
    got = {r.page_id: r.text for r in op8_html.main_text(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got == {i: "Title\nThe whole text of this page." for i in range(len(pages))}


def test_wrappers_generalise():
    def skeleton(source):
        return op8_html.skeleton(op8_html.Page(source).root)

    a, b = skeleton("<div><h1>x</h1><p>a</p></div>"), skeleton("<div><p>a</p><p>b</p><table></table></div>")
    assert op8_html.align(a, b) == op8_html.align(op8_html.align(a, b), b) == [["div", 0, 0, [["h1", 1, 0, [["#", 0, 0, []]]], ["p", 0, 1, [["#", 0, 0, []]]], ["table", 1, 0, []]]]]


def test_pages_query(spark, small):
    got = op8_html.op8_html_extraction(spark, small)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert got.count() == pages.count() and got.filter("n_chars <> length(text)").count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [
        (1, "u", None), (2, "u", "a\r\n\r\nWARC/1.1\r\nx"), (2, "u", "a\r\n\r\nWARC/1.1\r\nx"), (3, "u", "é" * 30_000), (3, "u", "é" * 30_000), (3, "u", "z" * 50_000),
        (4, None, "é" * 30_000), (5, "u", ""), (6, "x\ny", "q" * 40_000), (7, "u", "日本" * 5_000)]
    frame = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "'x' AS digest", "2 AS id", "'p' AS payload")
    op9_warc.write_archives(frame, str(tmp_path / "w"), segment_bytes=1000, records_per_file=5)
    back = op9_warc.reassemble(op9_warc.read_records(spark, str(tmp_path / "w"))).collect()
    got = collections.Counter((r.origin.split(":")[2], r.type, r.length, r.digest, r.refers_to and r.refers_to.split(":")[2]) for r in back)
    largest = {}
    for i, _, body in rows:
        largest[body or ""] = max(i, largest.get(body or "", 0))
    expected = collections.Counter()
    for i, _, body in rows:
        body = body or ""
        other = str(largest[body]) if largest[body] != i else None
        expected[(str(i), "revisit" if other else "response", len(body.encode()), op9_warc.digest(body.encode()), other)] += 1
    assert got == expected
    assert {bytes(r.payload) for r in back if r.type == "response"} == {(b or "").encode() for _, _, b in rows}


def test_missing_segment_is_an_error(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "q" * 5000)], "page_id int, url string, html string")
    op9_warc.write_archives(frame, str(tmp_path / "w"), segment_bytes=1000)
    parts = op9_warc.read_records(spark, str(tmp_path / "w"))
    with pytest.raises(Exception, match="incomplete"):
        op9_warc.reassemble(parts.filter("number <> 2")).collect()


def test_small_payloads_are_no_revisits(spark, tmp_path):
    frame = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], "page_id int, url string, html string")
    op9_warc.write_archives(frame, str(tmp_path / "w"), least_bytes=4)
    back = op9_warc.reassemble(op9_warc.read_records(spark, str(tmp_path / "w")))
    assert back.filter("type = 'response'").count() == 2


def test_chunked_framing():
    for body in (b"", b"a", b"x" * 9999, "é日".encode() * 999):
        assert op9_warc.from_chunks(op9_warc.to_chunks(body, 7)) == body
    assert op9_warc.from_chunks(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="does not end"):
        op9_warc.from_chunks(b"2\r\nabc\r\n0\r\n\r\n")
