"""Link sets of single pages: all routes, limits and messages."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import values as v
from gleaner.plans.source_sets import source_pages, source_sets

SITE = "http://town.example"


def entry(href, text, note="seen twice"):
    return (
        f'<article><p class="note">{note}</p>'
        f'<h3 class="head"><a href="{href}">{text}</a></h3></article>'
    )


def page(*entries):
    return (
        "<!doctype html>\n<html lang=en><head><title>Board</title></head><body>\n<main><section class=board>\n"
        + "\n".join(entries)
        + "\n</section></main></body></html>"
    )


HEADS = {
    "/plan/7": "Harbour crane moved to the north pier!",
    "/plan/8": "Who repairs the old ferry bell?",
    "/plan/9": "Snow closes both mountain roads tonight.",
    "/plan/10": "Council counts every street lamp again!",
}
BOARD = {SITE + path: text for path, text in HEADS.items()}
ABSOLUTE = page(*[entry(url, text) for url, text in BOARD.items()])
RELATIVE = page(*[entry(path + "?from=mail#top" * (path == "/plan/9"), text) for path, text in HEADS.items()])
BASES = ["https://north.example", "", "http://south.example:8080", "https://east.example"]
HOSTS = page(*[entry(base + path, text) for base, (path, text) in zip(BASES, HEADS.items())])
MANUAL = {"item_selector": "main section.board > article", "caption_selector": "h3 a",
          "link_selector": "h3.head > a"}
TWO_LISTS = """<!DOCTYPE html><html><body><section>
<p>Tides at the west quay <a href="/t/1">this week</a></p>
<p>Tides at the east quay <a href="/t/2">next week</a></p>
<p>Tides at the old mole <a href="/t/3">in August</a></p></section>
<footer><ul><li><a href="/m/6">Minutes of the June meeting</a></li>
<li><a href="/m/7">Minutes of the July meeting</a></li></ul></footer></body></html>"""
CARDS = """<html><body><header><a href="/start">Start</a></header>
<a class="tile" href="/hall"><p>New</p><h4>Market hall opens a roof garden</h4><p>Visitors climb forty narrow steps</p></a>
<a class="tile" href="/wall"><p>New</p><h4>City wall gets its third gate</h4><p>Carts may use it on Mondays</p></a>
<a class="tile" href="/well"><p>New</p><h4>Well water is clear once more</h4><p>The pump runs from six o'clock</p></a>
</body></html>"""
MANY = page(*[entry(f"/n/{i}", f"Story number {i} of this list") for i in range(3)])
TWICE = page(entry("/same", "The first text of it"), entry("/same", "The last text of it"),
             entry("/other", "Some other text is here"))
RSS = """<?xml version="1.0"?>
<!-- made by hand -->
<rss version="2.0"><channel><title>Feed</title><link>http://f.example.com</link>
<image><link>http://f.example.com/logo</link></image>
<item><title>One &amp; only</title><link>http://f.example.com/1?a=b#c</link><description>d1</description></item>
<item><link>http://f.example.com/2</link><description>No title here</description></item>
</channel></rss>"""
RSS_OLD = """<rss version="0.91"><channel><item><title>Old</title><link>http://f.example.com/o</link>
<source url="x">s</source></item></channel></rss>"""
ATOM = """<?xml version="1.0" encoding="utf-8"?>
<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title><link href="http://at.example.com/"/>
<entry><title type="text">Entry one</title><link rel="self" href="http://at.example.com/self"/>
<link rel="alternate" href="http://at.example.com/1"/><summary>s</summary></entry>
<entry><title></title><link href="http://at.example.com/2"/><summary>Summary two</summary></entry>
</feed>"""
BODY_ONLY = "<html><body><p>text <a href='/x'>alone</a></p></body></html>"
BAD_URLS = """<html><body><ul><li><a href="/ok">This link is fine</a></li>
<li><a href="http://h/%zz">This link is broken</a></li><li><a>This one has none</a></li></ul></body></html>"""

# name -> (page, settings, status), (items, messages)
CASES = {
    "auto": (ABSOLUTE, {}, 200, BOARD, []),
    "relative": (RELATIVE, {}, 200, BOARD, []),
    "link selector": (RELATIVE, {"link_selector": "a"}, 0, BOARD, []),
    "manual": (ABSOLUTE, MANUAL, 200, BOARD, []),
    "hosts": (HOSTS, {}, 204,
              {(base.replace("https:", "http:") or SITE) + path: text for base, (path, text) in zip(BASES, HEADS.items())}, []),
    "long note": (
        page(entry("/g/1", "The lower gate is shut", "seen again by two wardens"),
             entry("/g/2", "The upper gate is open", "seen again by two wardens")), {}, 200,
        {f"{SITE}/g/1": "seen again by two wardens. The lower gate is shut.",
         f"{SITE}/g/2": "seen again by two wardens. The upper gate is open."}, []),
    "ambiguous link": (ABSOLUTE, {**MANUAL, "link_selector": "*"}, 200, {}, [v.MSG_AMBIGUOUS_LINK]),
    "ambiguous caption": (ABSOLUTE, {**MANUAL, "caption_selector": "p, h3"}, 200,
                          {url: v.AMBIGUOUS_CAPTION for url in BOARD}, []),
    "no link": (ABSOLUTE, {**MANUAL, "link_selector": "a:nth-of-type(2)"}, 200, {}, [v.MSG_NO_LINK]),
    "not a link": (ABSOLUTE, {**MANUAL, "link_selector": ".head"}, 200, {},
                   ["The link selector does not match a link but rather h3."]),
    "no caption": (ABSOLUTE, {**MANUAL, "caption_selector": "span.none"}, 200, {}, []),
    "no link selector": (ABSOLUTE, {**MANUAL, "link_selector": None}, 200, {},
                         [v.MSG_NO_LINK_SELECTOR]),
    "manual ignores format": ("<body><p class=i><a href=/q>Ask me</a></p>",
                              {"item_selector": "p", "caption_selector": "a", "link_selector": "a"},
                              200, {f"{SITE}/q": "Ask me"}, []),
    "error ends the list": (
        page(entry("/1", "One"), entry("/2", "Two"), "<article><b>none</b></article>", entry("/4", "Four")),
        MANUAL, 200, {f"{SITE}/1": "One", f"{SITE}/2": "Two"}, [v.MSG_NO_LINK]),
    "no match": (ABSOLUTE, {"link_selector": "table a"}, 200, {}, [v.MSG_NO_MATCH % SITE]),
    "two lists": (TWO_LISTS, {}, 200, {
        f"{SITE}/t/1": "Tides at the west quay this week.",
        f"{SITE}/t/2": "Tides at the east quay next week.",
        f"{SITE}/t/3": "Tides at the old mole in August.",
        f"{SITE}/m/6": "Minutes of the June meeting.",
        f"{SITE}/m/7": "Minutes of the July meeting."}, []),
    "cards": (CARDS, {}, 200, {
        f"{SITE}/hall": "Market hall opens a roof garden. Visitors climb forty narrow steps.",
        f"{SITE}/wall": "City wall gets its third gate. Carts may use it on Mondays.",
        f"{SITE}/well": "Well water is clear once more. The pump runs from six o'clock."}, [v.MSG_BODY]),
    "lone link": (BODY_ONLY, {}, 200, {}, [v.MSG_BODY]),
    "bad urls": (BAD_URLS, {}, 200, {f"{SITE}/ok": "This link is fine."}, [v.MSG_BAD_LINK_URL]),
    "400": (ABSOLUTE, MANUAL, 400, {}, [v.MSG_400 % 400]),
    "500": (ABSOLUTE, MANUAL, 500, {}, [v.MSG_5XX % 500]),
    "700": (ABSOLUTE, MANUAL, 700, {}, [v.MSG_600 % 700]),
    "404": (ABSOLUTE, {}, 404, {}, [v.MSG_404]),
    "403": (ABSOLUTE, {}, 403, {}, [v.MSG_403]),
    "429": (ABSOLUTE, {}, 429, {}, [v.MSG_429]),
    "301": (ABSOLUTE, {}, 301, {}, []),
    "rss": (RSS, {}, 200, {"http://f.example.com/1?a=b#c": "One & only",
                           "http://f.example.com/2": "No title here"}, []),
    "old rss": (RSS_OLD, {"link_selector": "a"}, 200, {"http://f.example.com/o": "Old"}, []),
    "atom": (ATOM, {}, 200, {"http://at.example.com/1": "Entry one",
                             "http://at.example.com/2": "Summary two"}, []),
    "loose feed": ("<rss><channel><item><title>Salt &nbsp;&amp; vinegar&rsquo;s R&D \x0b</title>"
                   "<link>http://f.example.com/s?a=1&b=2</link></item></channel></rss>", {}, 200,
                   {"http://f.example.com/s?a=1&b=2": "Salt \u00a0& vinegar\u2019s R&D"}, []),
    "long line": ("<html><script>" + "x" * 70000 + "</script>" + ABSOLUTE[16:].replace("\n", " "), {}, 200, BOARD, []),
    "broken feed": ("<rss><channel><item></rss>", {}, 200, {}, [v.MSG_BAD_FEED]),
    "empty feed": ("<rss version='2.0'><channel><title>t</title></channel></rss>", {}, 200, {}, []),
    "no format": ("just text", {}, 200, {}, [v.MSG_NO_FORMAT]),
    "limit 2": (MANY, {"max_items": 2}, 200, {
        f"{SITE}/n/{i}": f"Story number {i} of this list." for i in range(2)}, []),
    "limit 5": (MANY, {"max_items": 5}, 200, {
        f"{SITE}/n/{i}": f"Story number {i} of this list." for i in range(3)}, []),
    "twice": (TWICE, {}, 200, {f"{SITE}/same": "The last text of it.",
                               f"{SITE}/other": "Some other text is here."}, []),
    "null": (None, {}, 200, {}, [v.MSG_NULL_PAGE]),
    "unfetched": ("", {}, "missing", {}, [v.MSG_NULL_PAGE]),
}

SOURCE = ("src STRING, name STRING, url STRING, item_selector STRING, caption_selector STRING, "
          "link_selector STRING, max_items INT, min_element_words INT, src_ord BIGINT")


@pytest.fixture(scope="module")
def sets(spark):
    sources, fetched = [], []
    for i, (name, (html, settings, status, _, _)) in enumerate(CASES.items()):
        s = {"max_items": 0, "min_element_words": 3, **settings}
        sources.append((name, name, SITE, s.get("item_selector"), s.get("caption_selector"),
                        s.get("link_selector"), s["max_items"], s["min_element_words"], i))
        if status != "missing":
            fetched.append((name, status, html))
    joined = source_pages(
        spark.createDataFrame(sources, SOURCE),
        spark.createDataFrame(fetched, "src STRING, status INT, html STRING"),
    )
    return {r.src: r for r in source_sets(joined).collect()}


@pytest.mark.parametrize("name", CASES)
def test_set(sets, name):
    _, _, _, items, messages = CASES[name]
    row = sets[name]
    assert {x.link_url: x.caption for x in row["items"]} == items
    assert row.messages == messages


def test_names(sets):
    assert sets["null"].name == ""
    assert sets["unfetched"].name == "unfetched"
    assert len(sets) == len(CASES)


def test_plan_has_one_parse_and_no_shuffle_of_pages(spark):
    pages = spark.createDataFrame([("a", 200, ABSOLUTE)], "src STRING, status INT, html STRING")
    rows = pages.select(
        "*", F.col("src").alias("name"), F.lit(SITE).alias("url"), F.lit(5).alias("max_items"),
        F.lit(3).alias("min_element_words"), F.lit(0).cast("bigint").alias("src_ord"),
        F.lit(True).alias("fetched"),
    )
    plan = source_sets(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "Exchange" not in plan
