import html
import re

import pytest
from pyspark.sql import functions as F

from cellgauge.llm import wrappers
from cellgauge.llm.markup import Reader
from cellgauge.llm.queries import QUERIES


def brute(page):
    """The pages of the tables hold one article of h1 and p, with b left open and cut pages."""
    found = re.search(r"<article[^>]*>(.*?)(?:</article>|\Z)", page or "", re.S)
    if not found:
        return ""
    body = re.sub(r"<[^>]*\Z", "", found[1]).replace("<br>", " ")
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:h1|p)>", body)]
    return "\n".join(b for b in blocks if b)


def words(*seed, n=30):
    return " ".join(f"w{'x'.join(map(str, seed))}y{k}" for k in range(n))


def texts(spark, pages, host="a.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return [r.main_text for r in wrappers.main_text(df).orderBy("page_id").collect()]


def test_tables_against_brute_force(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
        got = {r.page_id: r for r in QUERIES["op11_html_extraction"](spark, folder).collect()}
        assert len(got) == len(pages)
        for page in pages:
            row = got[page.page_id]
            assert (row.url, row.text, row.n_chars) == (page.url, brute(page.html), len(brute(page.html)))


def test_hosts_without_marks(spark):
    menu = "<div><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div>"
    pages, want = [], []
    for i in range(5):
        parts = [f"<p>{words(i, j)}</p>" for j in range(i + 1)]
        more = f"<ul><li>one {i}<li>two</ul><p>{words(i, 'end')}" if i % 2 else ""
        pages.append(f"<html><body>{menu}<div><h1>Title {i}</h1>{''.join(parts)}{more}</div><div>All texts are ours</div></body>")
        want.append("\n".join([f"Title {i}", *[words(i, j) for j in range(i + 1)], *([f"one {i}", "two", words(i, "end")] if i % 2 else [])]))
    assert texts(spark, pages) == want


def test_named_parts_go(spark):
    pages = [
        f"<div class=cookie-notice>We use cookies</div><header><h2>Site {i}</h2></header><div id=content class='with-sidebar post'><h2>T{i}</h2>"
        f"<div>{words(i)}</div><dl><dt>a<dd>b{i}<dt>c<dd>d</dl><div class=post-comments><p>{words(i, 9, n=80)}</p></div></div>"
        f"<aside><article>{words('aside', i)}</article></aside><form><label>Name {i}<input></form><p hidden>secret {i}</p>"
        for i in range(4)
    ]
    assert texts(spark, pages) == [f"T{i}\n{words(i)}\na\nb{i}\nc\nd" for i in range(4)]


def test_articles_keep_their_headers_and_constants(spark):
    pages = [
        f"<nav>menu</nav><main><article><header><h1>T{i}</h1></header><p>same on all pages</p><p>a<b>b</b>&amp;&lt;i&gt;<br>c\n\t d{i}&nbsp;e</p>"
        f"<footer>by {i}</footer><section class='comments'><article>reader {words(i)}</article></section></article><div class=related><article>x</article></div></main>"
        for i in range(4)
    ]
    assert texts(spark, pages) == [f"T{i}\nsame on all pages\nab&<i> c d{i} e" for i in range(4)]


def test_a_title_before_the_article(spark):
    pages = [f"<header><h1>Site</h1></header><main><div><h1>T{i}</h1></div><article><p>{words(i)}</article></main>" for i in range(3)]
    assert texts(spark, pages) == [f"T{i}\n{words(i)}" for i in range(3)]


def test_a_form_around_the_page(spark):
    pages = [f"<form action=/><nav>n</nav><div><h1>T{i}</h1><p>{words(i)}</p><button>go</button></div></form>" for i in range(3)]
    assert texts(spark, pages) == [f"T{i}\n{words(i)}" for i in range(3)]


def test_awkward_pages(spark):
    rows = [
        (1, None, None), (2, "no address", ""), (3, "http://a.example/1", "plain text\n only"), (4, "http://a.example/2", "<p>x"),
        (4, "http://a.example/2", "<p>x"), (None, "http://b.example", "<script>var a='<p>no</p>'</script><p>yes<!-- <p>no -->"),
        (5, "http://b.example/2", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>" + "long " * 200_000 + "</article>"),
        (6, "HTTP://B.example:80/3", "<article>cut <b>in a tag <a hre"), (7, "http://b.example/4", "<nav>only a menu</nav>"), (8, "http://c.example", "</p></div><a \"b<"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, MAIN_TEXT string, page_wrapper string")
    made = wrappers.main_text(df)
    assert made.columns == ["page_id", "url", "page_wrapper", "main_text"]
    got = sorted((str(r.page_id), r.main_text) for r in made.collect())
    want = [("1", ""), ("2", ""), ("3", "plain text only"), ("4", "x"), ("4", "x"), ("None", "yes"), ("5", "deep\n" + ("long " * 200_000).strip())]
    want += [("6", "cut in a tag"), ("7", ""), ("8", "")]
    assert got == sorted(want)
    assert wrappers.main_text(df.limit(0)).count() == 0
    hosts = {r.host: r.pages for r in wrappers.infer(df).collect()}
    assert hosts == {"": 2, "a.example": 3, "b.example": 4, "c.example": 1}


def test_levels_and_partitions_give_the_same_text(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("url", F.lit("http://one.example/"))
    want = {r.page_id: brute(r.html) for r in pages.collect()}
    for n, fan in ((1, 64), (24, 2), (24, 64)):
        found = wrappers.infer(pages.repartition(n), fan=fan)
        assert found.count() == 1 and found.first().pages == len(want)
        got = wrappers.extract(pages, found, keep=["page_id"])
        assert {r.page_id: r.main_text for r in got.collect()} == want


def test_pages_without_a_wrapper(spark):
    df = spark.createDataFrame([(1, "http://new.example", "<nav>n</nav><article>text</article>")], "page_id bigint, url string, html string")
    none = wrappers.infer(df.limit(0))
    assert wrappers.extract(df, none).first().main_text == "text"


def shape(*pages):
    reader = Reader()
    return str(wrappers.align_all([wrappers.expression(reader.read(p)) for p in pages]))


@pytest.mark.parametrize(
    "pages, pattern",
    [
        (["<p>a", "<p>b"], "page(p(#))"),
        (["<p>a", "<p>a<p>b<p>c"], "page(p(#)+)"),
        (["<h1>a</h1><p>b", "<p>c"], "page(h1(#)? p(#))"),
        (["<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"], "page(dl((dt(#) dd(#))+))"),
        (["<h2>a</h2><p>b<p>c<h2>d</h2><p>e"], "page((h2(#) p(#)+)+)"),
        (["<h2>a</h2><p>b<h2>c</h2>"], "page((h2(#) p(#)?)+)"),
        (["<p>a<h2>b</h2>", "<h2>a</h2><p>b"], "page((p(#)? h2(#)?)+)"),
        (["<div><p>a</div><div><ul><li>b</ul></div>", "<div><p>c</div>"], "page(div(p(#)) div(ul(li(#)))?)"),
    ],
)
def test_alignment(pages, pattern):
    assert shape(*pages) == pattern


def test_many_kinds_are_told_apart_by_name_only():
    pages = ["".join(f"<div class=k{chr(97 + i // 26)}{chr(97 + i % 26)}>t{i}</div>" for i in range(200)) + "<div class=ads>x</div>"]
    found = wrappers.own_wrapper(Reader().read(pages[0]))
    assert found.text(Reader().read(pages[0])) == "\n".join(f"t{i}" for i in range(200))
    assert len(shape(*pages)) < 100
