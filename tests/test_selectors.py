"""Selector grammar and matching."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import selectors
from gleaner.sources.dom import with_nodes

PAGE = """<!doctype html><html><body>
<div id="top" class="box wide"><p class="x">1</p><span class="y">2</span><span class="y z">3</span></div>
<ul><li>a <a href="/1">one</a> <a href="/2">two</a></li><li>b <a data-k="v" href="/3">three</a></li>
<li><b><a href="/4">four</a></b></li></ul>
<div class="wide"><ul><li><div><a href="/5">five</a></div></li></ul></div>
</body></html>"""

VALID = [
    "nav > p", "x-card", "*", "main#news.front ~ aside.side", "h2,h3 , h4", "td[align!=left]", "tr:nth-child(3n+2)",
    "dd:nth-of-type( even )", "tr:nth-child(-n + 5):not(.head)", 'img[alt="one, two"], em', "TABLE[ID]",
    "td:empty", "dl:last-child dt:only-child", "tr:nth-of-type(4)",
]
# selectors that must be refused
INVALID = ["tr td:third-of-type(2)", "7up", "em:not()", "", "img[", "nav >", "+ nav", "h2,,h3", "td:not(b i)", "tr:nth-child(2n+)"]


@pytest.mark.parametrize("text,ok", [(t, True) for t in VALID] + [(t, False) for t in INVALID])
def test_validity(spark, text, ok):
    df = spark.createDataFrame([(text,)], "s STRING")
    assert df.select(selectors.is_valid(F.col("s"))).first()[0] is ok


CASES = {
    "a": ["/1", "/2", "/3", "/4", "/5"],
    "ul > li > a": ["/1", "/2", "/3"],
    "ul li a:nth-of-type(2)": ["/2"],
    "li:nth-of-type(3) a": ["/4"],
    "div.wide a": ["/5"],
    "div ul > li a": ["/5"],
    "a + a": ["/2"],
    "li ~ li a": ["/3", "/4"],
    "a[data-k]": ["/3"],
    "a[data-k='v'], b a": ["/3", "/4"],
    "a[href=\"/2\"]": ["/2"],
    "#top a": [],
    "a[href^='/1'], a[href$='5']": ["/1", "/5"],
    "a[href*=\"3\"]": ["/3"],
    "div[class~=wide] a": ["/5"],
    "a[data-k|=v]": ["/3"],
    "a[href^='']": [],
    "li:first-child a": ["/1", "/2", "/5"],
    "body > :nth-child(2) li:nth-child(2) a": ["/3"],
    "a:first-of-type": ["/1", "/3", "/4", "/5"],
    "body>ul a": ["/1", "/2", "/3", "/4"],
    "li > div > a, li > b > a": ["/4", "/5"],
    "A[HREF='/3']": ["/3"],
    "a[href!='/3']": ["/1", "/2", "/4", "/5"],
    "li:nth-child(odd) a": ["/1", "/2", "/4", "/5"],
    "li:nth-child(even) a": ["/3"],
    "li:nth-of-type(2n+1) > a": ["/1", "/2"],
    "li:nth-child(-n+2) a": ["/1", "/2", "/3", "/5"],
    "li:last-child a": ["/4", "/5"],
    "a:only-child": ["/3", "/4", "/5"],
    "a:not([data-k])": ["/1", "/2", "/4", "/5"],
    "li > :not(a) a": ["/4", "/5"],
    "div:not(.box) a, a[title=\"x, y\"]": ["/5"],
    "a:empty": [],
    "li:nth-last-child(2) a": ["/3"],
    "li:nth-last-child(n+2) a": ["/1", "/2", "/3"],
    "a:nth-last-of-type(2)": ["/1"],
    "a:last-of-type": ["/2", "/3", "/4", "/5"],
    "a:only-of-type": ["/3", "/4", "/5"],
    "li:has(b) a": ["/4"],
    "li:has([data-k]) > a, div:has(div) a": ["/3", "/5"],
    "li:not(.x):has(div) a": ["/5"],
    "ul:has(p) a": [],
    "li:has(a[data-k]) a, ul:has(div.x) a": ["/3"],
    "li a:not([data-k][href='/3']):not(a[href='/1'])": ["/2", "/4", "/5"],
}


def test_matches(spark):
    pages = spark.createDataFrame([(s, PAGE) for s in CASES], "s STRING, html STRING")
    df = with_nodes(pages).select(
        "s",
        F.transform(
            selectors.select(F.col("nodes"), selectors.parse(F.col("s"))),
            lambda i: F.get("nodes", i).attrs["href"],
        ).alias("hrefs"),
    )
    assert {r.s: r.hrefs for r in df.collect()} == CASES


def test_classes_and_siblings(spark):
    cases = {"span.y": ["2", "3"], "span.z.y": ["3"], "p ~ span": ["2", "3"], "p + span": ["2"],
             "div#top.box p.x": ["1"], "p:first-child": ["1"], "span ~ p": []}
    pages = spark.createDataFrame([(s, PAGE) for s in cases], "s STRING, html STRING")
    df = with_nodes(pages).select(
        "s",
        F.transform(
            selectors.select(F.col("nodes"), selectors.parse(F.col("s"))),
            lambda i: F.get("nodes", i + 1).txt,
        ).alias("texts"),
    )
    assert {r.s: r.texts for r in df.collect()} == cases


def test_escaped_and_other_names(spark):
    page = '<p class="wide:box é">1</p><p class="wide" id="a.b">2</p><p class="box">3</p><i-é>4</i-é>'
    cases = {r".wide\:box": ["1"], r"#a\.b": ["2"], ".é": ["1"], r"p:not(.wide\:box)": ["2", "3"],
             r".\:first-child": [], r"p.box:nth-last-of-type(1)": ["3"], r"body:has(#a\.b) .wide": ["2"]}
    pages = spark.createDataFrame([(s, page) for s in cases], "s STRING, html STRING")
    found = selectors.select(F.col("nodes"), selectors.parse(F.col("s")))
    df = with_nodes(pages).select("s", F.transform(found, lambda i: F.get("nodes", i + 1).txt).alias("texts"))
    assert {r.s: r.texts for r in df.collect()} == cases


def test_many_siblings_take_no_longer_than_a_sort(spark):
    page = spark.createDataFrame([("<ul>" + "<li>x</li>" * 30000 + "</ul>",)], "html STRING")
    last = selectors.select(F.col("nodes"), selectors.parse(F.lit("ul:has(li) > li:nth-last-child(-n+2)")))
    assert with_nodes(page).select(F.size(last)).first()[0] == 2


def test_only_nodes_that_fit_are_sorted(spark):
    """A step ranks the nodes that fit and those found before, not all of a page."""
    html = "<div>" + "<p>x</p>" * 300 + "<ul><li><a href=/1>a</a></ul></div>"
    df = with_nodes(spark.createDataFrame([(html,), ("",)], "html STRING"))
    own = F.filter("nodes", lambda n: n.tag == "a")
    found = F.filter("nodes", lambda n: n.tag.isin("div", "ul"))
    for counts in (selectors.found_ancestor_counts(own, found), selectors.earlier_sibling_counts(own, found),
                   selectors.found_counts(F.transform(own, lambda n: n.parent), found)):
        assert [len(r[0]) for r in df.select(counts).collect()] == [1, 0]
    assert [r[0] for r in df.select(selectors.found_ancestor_counts(own, found)).collect()] == [[2], []]
    nothing = selectors.select(F.col("nodes"), selectors.parse(F.lit("7up")))
    assert [r[0] for r in df.select(nothing).collect()] == [[], []]
