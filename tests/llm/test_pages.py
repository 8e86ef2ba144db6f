import html as references
import re

import numpy as np
from odd import ODD
from pyspark.sql import functions as F

from auditframe.llm import crf, pages
from auditframe.llm.queries import QUERIES


def texts(page):
    return [b.text for b in pages.leaf_blocks(page)]


def test_blocks_of_loose_markup():
    assert texts("<p>a&nbsp;b <b>c<br>d</b><p>x &lt;y &am<ul><li>1<li>2</ul>t") == ["a b c d", "x <y &am", "1", "2", "t"]
    assert texts("<!DOCTYPE html><title>T&amp;U</title><style>p{}</style><script>var t='</p>';</script><p>z") == ["T&U", "z"]
    assert texts("a<!-- <p>no</p> -->b<div>c</div >d") == ["ab", "c", "d"]
    assert texts('<p title="a>b">x</p><a href=\'>\'>y</a>') == ["x", "y"]
    assert texts("<script>never closed <p>x") == [] and texts("<!-- never closed <p>x") == []
    assert texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    assert texts("</p></div>x<br/>y<hr>z<") == ["x y", "z<"]


def test_quotes_and_short_comments():
    """A quote opens a value only behind an equals sign, and some comments end where they begin."""
    assert texts('<article><p class=foo">Hello world</p><p>Second <a href="x">link</a></p></article>') == ["Hello world", "Second link"]
    assert texts("<p don't>one</p><p>two it's</p>") == ["one", "two it's"]
    assert texts("<!-->shown<p>a</p>") == ["shown", "a"] and texts("<!--->shown<p>a</p>") == ["shown", "a"]
    assert texts("<!-- a > b -- c --!>shown<p>a</p>") == ["shown", "a"]
    assert texts("<p a = \"x>y\" b='>' c=d/e>in</p>") == ["in"] and texts('<p "q">in</p>') == ["in"]
    assert texts("<a href=/x/>y</a></>z</ bogus>w") == ["yzw"] and texts("<p a=>b</p>") == ["b"]
    assert texts('<p a="never closed>x</p>') == [] and texts("<p\xa0x>one</p>") == ["one"]


def test_all_ancestors_and_digits_are_read():
    deep = "<div>" * 40 + '<div class="comments">' + "<div>" * 40 + "text"
    (block,) = pages.leaf_blocks(deep)
    assert pages._bucket("name comments") in pages.block_features([block])[0] and len(block.path) == 81
    (long,) = pages.leaf_blocks("<p>" + "x" * 64 + "1" * 400)
    assert pages._bucket("digits 3") in pages.block_features([long])[0]


def test_paths_close_what_html_closes():
    path = lambda page: [[t for t, _ in b.path] for b in pages.leaf_blocks(page)]
    assert path("<div><p><b>x<p>y</div>z") == [["div", "p", "b"], ["div", "p"], []]
    assert path("<table><tr><td>a<td>b<tr><td>c</table>d") == [["table", "tr", "td"]] * 3 + [[]]
    assert path("<ul><li>a<ul><li>b</ul><li>c</ul>") == [["ul", "li"], ["ul", "li", "ul", "li"], ["ul", "li"]]


PAGE = """<html><head><title>t</title></head><body><header class="masthead"><a href="/">Site name</a></header>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="cookie-banner">We use cookies. <a href=/c>Accept</a></div>
<article><h1>The river rises</h1><p>After days of rain the river has risen, and the town has closed two of its bridges.</p>
<div class="ad">Buy boats now!</div><p>People watch &amp; wait.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>What a river that is, I saw it.</p></div></section>
<aside class="sidebar"><ul><li><a href=/d>Most read</a></li></ul></aside>
<form class="newsletter"><label>Mail</label><button>Send</button></form>
<footer>&copy; 2024 Site name</footer></body></html>"""


def test_article_alone_is_taken():
    chain = pages.fit([PAGE])
    blocks = list(pages.leaf_blocks(PAGE))
    main = crf.viterbi(chain, pages._grid(pages.block_features(blocks)).sums(chain.weights), np.array([0]))
    assert [b.text for b, y in zip(blocks, main, strict=True) if y] == [
        "The river rises", "After days of rain the river has risen, and the town has closed two of its bridges.", "People watch & wait.",
    ]


def test_held_out_pages_of_other_layouts():
    chain = pages.fit([PAGE], seed=1)
    own = [b.text for b in pages.leaf_blocks(PAGE)]
    wrong = total = 0
    for i in range(200):
        blocks = list(pages.leaf_blocks(pages._Maker(10_000_000 + i, own).page()))
        main = crf.viterbi(chain, pages._grid(pages.block_features(blocks)).sums(chain.weights), np.array([0]))
        wrong += sum(int(y) != pages.truth(b) for b, y in zip(blocks, main, strict=True))
        total += len(blocks)
    assert wrong / total < 0.02


def test_odd_pages(spark):
    chain = pages.fit([PAGE])
    rows = [(i, "u", h) for i, h in enumerate([*ODD, PAGE, PAGE, "<p>" * 3000 + "deep", "<article>" + "<p>one line of text.</p>" * 3000])]
    frame = spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("old"))
    got = pages.extract(frame, chain).collect()
    assert len(got) == len(rows) + 1 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got[:3]] == [""] * 3 and got[-1].text == ""
    assert got[len(ODD)].text == got[len(ODD) + 1].text != ""
    assert got[-2].text.count("\n\n") >= 2990
    assert pages.extract(frame.limit(0), chain).count() == 0
    dotted = pages.extract(frame.limit(2).withColumn("a.b", F.lit(1)), chain).collect()
    assert [r["a.b"] for r in dotted] == [1, 1]
    assert isinstance(pages.learn(frame.limit(0)), crf.Chain)


def test_query_on_given_pages(spark):
    """The given pages have one article element each, of headings and paragraphs."""
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in QUERIES["op3_crf_pages"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert set(got) == {r.page_id for r in rows}
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        parts = [" ".join(references.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].url == r.url


def test_deep_pages_cost_linear_time():
    deep = "<div>word " * 20_000
    blocks = list(pages.leaf_blocks(deep))
    assert len(blocks) == 20_000 and len(pages.block_features(blocks)) == 20_000
    assert texts("<p " + "a" * 500_000) == [] and texts("<p " + "a='" * 200_001 + ">x") == [] and texts("<p " + "= " * 200_000 + ">x") == ["x"]
    assert len(list(pages.leaf_blocks("<ul><li>x" * 5000 + "</i></b></nav>" * 20_000))) == 5000
