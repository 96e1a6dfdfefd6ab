"""Seen store, digests and whole runs."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from gleaner.functions import values as v
from gleaner.functions.text import escape_href, escape_html
from gleaner.operators import items as op, sections, store
from gleaner.plans.digest import run_digest, run_items
from gleaner.plans.source_sets import source_pages, source_sets
from gleaner.sources.configs import with_unique_keys
from gleaner.sources.tables import broadcast_if_small, new_dir

ITEMS = "src STRING, src_ord BIGINT, ord INT, link_url STRING, caption STRING"
SITE = "http://www.example.com"


def site(links):
    body = "".join(f'<li><p>{text}</p><a href="{href}">go</a></li>' for href, text in links)
    return f"<!doctype html><html><body><ul>{body}</ul></body></html>"


def sources(spark, names, max_items=0):
    rows = [(n, n, SITE, max_items, 1, i) for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows, "src STRING, name STRING, url STRING, max_items INT, min_element_words INT, src_ord BIGINT"
    )


def fetched(spark, pages):
    rows = [(n, 200, html) for n, html in pages.items()]
    return spark.createDataFrame(rows, "src STRING, status INT, html STRING")


def body_of(folder):
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(f"{folder}/part-*")))
    return text[:-1]


FIVE = [(f"/{i}", f"Story number {i}") for i in range(5)]
CHANGED = [(f"/{i}", f"Story number {i}") for i in range(3)] + [("/x", "New one"), ("/y", "New two")]


def test_second_run_shows_changes_only(spark):
    out = new_dir(spark, "test")
    seen = f"{out}/seen"
    src = sources(spark, ["one", "two"])

    def run(n, now, one, two):
        pages = fetched(spark, {"one": site(one), "two": site(two)})
        return run_digest(src, pages, f"{now} 00:00:00", f"{out}/{n}", seen, n)

    first = run(0, "2024-01-01", FIVE, FIVE[:2])
    assert store.read_seen(spark, seen).count() == 5
    again = run(1, "2024-01-02", FIVE, FIVE[:2])
    assert spark.read.parquet(again.items).count() == 0
    for _ in range(2):  # a repeated run gives the same
        third = run(2, "2024-01-03", CHANGED, FIVE)
        got = {(r.src, r.link_url, r.caption) for r in spark.read.parquet(third.items).collect()}
        assert got == {("one", f"{SITE}/x", "New one. go."), ("one", f"{SITE}/y", "New two. go.")}
        assert store.read_seen(spark, seen).count() == 7
    before = {r.item for r in sections.extract_items(bodies(spark, first.html)).collect()}
    after = {r.item for r in sections.extract_items(bodies(spark, third.html)).collect()}
    assert len(before) == 5 and len(after) == 2 and not before & after
    html, text = body_of(third.html), body_of(third.text)
    assert html.count("<h2>") == 2 and v.NO_LINKS in html and "New one. go." in text
    # keys keep the time of their first sight, and expire by it
    assert store.read_seen(spark, seen).filter("seen_at = '2024-01-01'").count() == 5
    later = run(3, "2024-07-01", FIVE, [])
    assert spark.read.parquet(later.items).count() == 5
    live = store.cleanup(store.read_seen(spark, seen), "2024-07-01 00:00:00")
    assert live.count() == 5
    store.write_compacted(live, f"{out}/compacted")
    kept = store.read_seen(spark, f"{out}/compacted")
    assert sorted(map(tuple, kept.select("link_key", "seen_at").collect())) == sorted(
        map(tuple, live.collect())
    )
    folders = store.alive(kept, "2024-08-01 00:00:00", 60)._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(seen_date" in folders.toString()


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_relevant_part_of_the_store(spark, max_bytes):
    seen = spark.range(1000).selectExpr("concat('k', id) AS link_key", "now() AS seen_at")
    keys = spark.range(990, 1010).selectExpr("concat('k', id) AS link_key")
    part = store.relevant(seen, keys, max_bytes)
    assert part.count() == (1000 if max_bytes == 0 else 10)
    assert keys.join(part, "link_key", "left_anti").count() == 10


def bodies(spark, folder):
    return spark.read.text(folder, wholetext=True).select(F.col("value").alias("body"))


def test_run_without_store(spark):
    out = new_dir(spark, "test")
    run = run_digest(sources(spark, ["one", "two"], 3),
                     fetched(spark, {"one": site(FIVE), "two": site(FIVE)}), "2024-01-01", out)
    assert sorted(os.path.basename(f) for f in glob.glob(f"{out}/*")) == ["html", "items", "sets", "text"]
    # nothing is remembered, not even within the run; the limit holds per source
    assert spark.read.parquet(run.items).groupBy("src").count().collect()[0]["count"] == 3
    assert spark.read.parquet(run.items).count() == 6


def test_cap_before_lookup(spark):
    """A source whose first items are all known shows none."""
    src = sources(spark, ["one"], 2)
    sets = source_sets(source_pages(src, fetched(spark, {"one": site(FIVE)})))
    known = store.entries(op.explode_items(sets), "2024-01-01 00:00:00")
    assert run_items(sets, known, "2024-01-02 00:00:00").count() == 0


def test_changed_caption_is_new_and_first_source_wins(spark):
    rows = [("b", 1, 0, "u", "x"), ("a", 0, 5, "u", "x"), ("c", 2, 0, "u", "y"), ("c", 2, 1, "w", "z")]
    items = spark.createDataFrame(rows, ITEMS)
    known = store.entries(items.filter("caption = 'z'"), "2024-01-01")
    got = store.new_items(items, known, "2024-02-01")
    assert {(r.src, r.caption) for r in got.collect()} == {("a", "x"), ("c", "y")}
    # without separator between caption and URL, as keys always were
    keys = op.with_key(spark.createDataFrame([("s", 0, 0, "bc", "a"), ("s", 0, 1, "c", "ab")], ITEMS))
    assert keys.select("link_key").distinct().count() == 1


GOLDEN_HTML = """<html>
<head>
</head>
<body>
	<p>Your link digest found the following links.</p>
	
		<h2>Site &amp; Sound</h2>
		<p></p>
		<ul>
		
			<li>A &lt;b&gt; story! (<a href="http://e.com/a?x=1&amp;y=2">here</a>)</li>
		
			<li>1 &#43; 1 isn&#39;t 3 (<a href="#ZgotmplZ">here</a>)</li>
		
		</ul>
	
		<h2>Empty</h2>
		<p>We could not find any links for this site. First. Second.</p>
		<ul>
		
		</ul>
	
</body>
</html>"""
GOLDEN_TEXT = """
Site &amp; Sound



- A &lt;b&gt; story!
  http://e.com/a?x=1&amp;y=2


- 1 &#43; 1 isn&#39;t 3
  javascript:x()



Empty

We could not find any links for this site. First. Second.


"""


def test_golden_bodies(spark):
    sets = spark.createDataFrame(
        [("a", 0, "Site & Sound", []), ("b", 1, "Empty", ["First.", "Second."])],
        "src STRING, src_ord BIGINT, name STRING, messages ARRAY<STRING>",
    )
    items = spark.createDataFrame(
        [("a", 0, 0, "http://e.com/a?x=1&y=2", "A <b> story!"),
         ("a", 0, 1, "javascript:x()", "1 + 1 isn't 3")], ITEMS)
    rows = sections.sections(sets, items)
    out = new_dir(spark, "test")
    sections.write_body(sections.render(rows, items, True), f"{out}/html")
    sections.write_body(sections.render(rows, items, False), f"{out}/text")
    assert body_of(f"{out}/html") == GOLDEN_HTML
    assert body_of(f"{out}/text") == GOLDEN_TEXT
    printed = []
    sections.print_body(sections.render(rows, items, True), printed.append)
    assert "\n".join(printed) == GOLDEN_HTML


def test_escape(spark):
    cases = {
        "http://e.com/ü x": "http://e.com/%c3%bc%20x", "/rel/a%20b": "/rel/a%20b", "a%zz": "a%25zz",
        "JavaScript:alert(1)": "#ZgotmplZ", ":x": "#ZgotmplZ", "MAILTO:a@b.c": "MAILTO:a@b.c",
        "/a:b": "/a:b", "x'(y)": "x%27%28y%29", "😀": "%f0%9f%98%80", "": "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c STRING")
    assert {r.c: r.e for r in df.select("c", escape_href(F.col("c")).alias("e")).collect()} == cases
    assert df.select(escape_html(F.lit("<&>\"'+")).alias("e")).first().e == "&lt;&amp;&gt;&#34;&#39;&#43;"


def test_remove_and_clean(spark):
    items = spark.createDataFrame([("s", 0, i, f"u{i}", c) for i, c in enumerate(["a", " \n\t", "c"])], ITEMS)
    assert {r.link_url for r in op.clean_items(items).collect()} == {"u0", "u2"}
    gone = spark.createDataFrame([("s", 0, 9, "u2", "other caption")], ITEMS)
    assert {r.link_url for r in op.remove_items(items, gone).collect()} == {"u0", "u1"}
    assert op.remove_items(items.limit(0), gone).count() == 0


def test_latest_snapshots(spark):
    pages = spark.createDataFrame(
        [(1, "a", 10, "x"), (2, "a", 30, "y"), (3, "a", 20, "z"), (4, "b", 5, "w")],
        "page_id BIGINT, src STRING, fetched_at INT, html STRING")
    latest = op.latest_snapshots(pages, "src", ["fetched_at"], "page_id")
    assert {(r.src, r.html) for r in latest.collect()} == {("a", "y"), ("b", "w")}


@pytest.mark.parametrize("spread", [1, 4, 64])
def test_cap_and_dedupe_with_a_hot_source(spark, spread):
    """One source holds most rows; results are those of a plain sort."""
    rows = [("hot", 0, i, f"u{i % 700}", f"c{i}") for i in range(2000)]
    rows += [(f"s{j}", j, i, f"u{i}", f"c{i}") for j in range(1, 30) for i in range(20)]
    limit = {"hot": 50, "s1": 0, "s2": 1}
    items = spark.createDataFrame(rows, ITEMS)
    last = {}
    for src, _, ord_, url, caption in rows:
        last[(src, url)] = (ord_, caption)
    deduped = op.dedupe_url(items)
    assert {(r.src, r.link_url): (r.ord, r.caption) for r in deduped.collect()} == last
    want = set()
    for src in {s for s, _ in last}:
        mine = sorted((o, u) for (s, u), (o, _) in last.items() if s == src)
        k = limit.get(src, 7)
        want |= {(src, u) for _, u in (mine[:k] if k else mine)}
    limits = spark.createDataFrame([(s, limit.get(s, 7)) for s in {s for s, _ in last}],
                                   "src STRING, max_items INT")
    capped = op.cap_items(deduped.join(limits, "src"), spread)
    assert {(r.src, r.link_url) for r in capped.collect()} == want


def test_broadcast_only_when_measured_small(spark):
    df = spark.range(1000).select(F.repeat(F.lit("x"), 100).alias("t"))
    small = broadcast_if_small(df, 1 << 20)._jdf.queryExecution().logical().toString()
    large = broadcast_if_small(df, 1 << 10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in small.lower() and "broadcast" not in large.lower()


def test_refetched_pages_and_equal_names(spark):
    out = new_dir(spark, "test")
    src = sources(spark, ["a", "b"]).withColumn("name", F.lit("News"))
    rows = [("a", 200, site(FIVE), 1), ("a", 200, site(CHANGED), 5), ("a", 200, site(CHANGED), 5),
            ("b", 200, site(FIVE[:2]), 3), ("b", 200, site(FIVE), None)]
    pages = spark.createDataFrame(rows, "src STRING, status INT, html STRING, day INT")
    pages = pages.withColumn("fetched_at", F.timestamp_seconds(F.col("day") * 86400))
    run = run_digest(src, pages, "2024-01-01 00:00:00", f"{out}/run")
    got = {r.src: [x.link_url for x in r["items"]] for r in spark.read.parquet(run.sets).collect()}
    assert got == {"a": [SITE + href for href, _ in CHANGED], "b": [f"{SITE}/0", f"{SITE}/1"]}
    html = body_of(run.html)
    assert html.count("<h2>") == html.count("</ul>") == 2


def test_repeated_keys_are_errors(spark):
    rows = [("x", 1, None), ("x", 2, None), ("y", 3, None), ("z", 4, "bad")]
    df = spark.createDataFrame(rows, "src STRING, src_ord BIGINT, error STRING")
    got = {r.src_ord: r.error for r in with_unique_keys(df).collect()}
    assert got == {1: v.ERR_REPEATED_KEY, 2: v.ERR_REPEATED_KEY, 3: None, 4: "bad"}
