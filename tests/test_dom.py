"""Tree building."""

from collections.abc import Iterator

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.sources import dom
from gleaner.sources.dom import node_table, parse_html, register
from gleaner.sources.pages import cap_page, read_page_files
from gleaner.sources.tables import new_dir


def shape(node):
    if node.kind != "element":
        return node.text.strip() if node.kind == "text" else f"!{node.text}"
    inner = [s for s in map(shape, node.children) if s]
    return f"{node.tag}({' '.join(inner)})" if inner else node.tag


@pytest.mark.parametrize("html,want", [
    ("", "html(head body)"),
    ("<p>a<p>b", "html(head body(p(a) p(b)))"),
    ("<title>a &lt; b</title><p>x", "html(head(title(a < b)) body(p(x)))"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "html(head body(ul(li(a) li(b ul(li(c))) li(d))))"),
    ("<table><tr><td>1<td>2<tr><th>3</table>x",
     "html(head body(table(tbody(tr(td(1) td(2)) tr(th(3)))) x))"),
    ("<p>a<div>b</div>c</p>", "html(head body(p(a) div(b) c p))"),
    ("<a href=1>x<a href=2>y</a>z", "html(head body(a(x) a(y) z))"),
    ("<p><b>a<p>b</b>c", "html(head body(p(b(a)) p(b(b) c)))"),
    ("<script>if (a<b) '</p>'</script><p>x", "html(head(script(if (a<b) '</p>')) body(p(x)))"),
    ("<div>a<br>b<img src=x>c</div></div>d", "html(head body(div(a br b img c) d))"),
    ("<!-- x --><html><!-- y --><body>a<!-- z -->b", "html(head body(a ! z  b))"),
    ("<select><option>a<option>b</select>", "html(head body(select(option(a) option(b))))"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "html(head body(dl(dt(a) dd(b) dt(c))))"),
    ("<h1>a<h2>b</h2>", "html(head body(h1(a) h2(b)))"),
    ("a < b <c", "html(head body(a < b))"),
    ("<svg><path/><g><circle/></g></svg>x", "html(head body(svg(path g(circle)) x))"),
    ("<noscript><p>x</p></noscript><p>y", "html(head(noscript(<p>x</p>)) body(p(y)))"),
    ("<body class=a><body id=b>x", "html(head body(x))"),
    ("<tr><td>x", "html(head body(x))"),
    ("<nav><ul><li><a href='/a'>a</a></li></ul></nav><p><b>x<br><p>y",
     "html(head body(nav(ul(li(a(a)))) p(b(x br)) p(b(y))))"),
])
def test_shape(html, want):
    assert shape(parse_html(html)) == want


def test_attributes():
    a = parse_html('<a HREF="/x?a=1&amp;b=2&copy=3&lt;" data-x class=\'p q\' href=second>t</a>')
    assert a.children[1].children[0].attrs == {
        "href": "/x?a=1&b=2&copy=3<", "data-x": "", "class": "p q"
    }


def test_node_table(spark):
    pages = spark.createDataFrame(
        [(1, "<ul><li>a<b>c</b></li><li>d</li></ul><p>e"), (2, None), (3, "")], "page_id BIGINT, html STRING"
    )
    rows = node_table(pages).orderBy("page_id", "nid").collect()
    one = [r for r in rows if r.page_id == 1]
    assert [(r.tag or r.txt, r.nid, r.parent, r.depth, r.last) for r in one] == [
        ("html", 0, -1, 0, 11), ("head", 1, 0, 1, 1), ("body", 2, 0, 1, 11), ("ul", 3, 2, 2, 9),
        ("li", 4, 3, 3, 7), ("a", 5, 4, 4, 5), ("b", 6, 4, 4, 7), ("c", 7, 6, 5, 7),
        ("li", 8, 3, 3, 9), ("d", 9, 8, 4, 9), ("p", 10, 2, 2, 11), ("e", 11, 10, 3, 11),
    ]
    assert [(r.tag, r.sib, r.nth, r.prev) for r in one if r.tag in ("li", "p")] == [
        ("li", 0, 1, -1), ("li", 1, 2, 4), ("p", 1, 1, 3)
    ]
    assert {r.page_id for r in rows} == {1, 3}


def test_depth_is_number_of_edges(spark):
    depths = list(range(1, 200, 7))
    pages = spark.createDataFrame(
        [(d, "<div>" * d + "<a href=x>y</a>") for d in depths], "page_id BIGINT, html STRING"
    )
    found = node_table(pages).filter(F.col("tag") == "a")
    assert {r.page_id: r.depth for r in found.collect()} == {d: d + 2 for d in depths}


def test_sql_function(spark):
    register(spark)
    spark.createDataFrame([(1, "<ul><li>a<li>b")], "page_id BIGINT, html STRING").createOrReplaceTempView("p")
    rows = spark.sql(
        "SELECT page_id, n.tag FROM p LATERAL VIEW explode(dom_nodes(html)) AS n WHERE n.tag = 'li'"
    )
    assert [tuple(r) for r in rows.collect()] == [(1, "li"), (1, "li")]


def test_page_files(spark):
    out = new_dir(spark, "test")
    pages = ["<p>one\n<p>two", "<p>three"]
    for i, page in enumerate(pages):
        spark.createDataFrame([(page,)], "v STRING").coalesce(1).write.text(f"{out}/{i}")
    read = read_page_files(spark, f"{out}/*/*.txt")
    assert sorted(r.html.rstrip("\n") for r in read.collect()) == sorted(pages)
    assert read.select("url").distinct().count() == 2


def test_page_cap(spark):
    df = spark.createDataFrame([("abcdef",), ("ab",), (None,)], "html STRING")
    got = [r.c for r in df.select(cap_page(F.col("html"), 4).alias("c")).collect()]
    assert got == ["abcd", "ab", None]


def test_places_from_the_end(spark):
    html = "<ul><li>a<li>b<!-- c --><p>d</p>e<li>f</ul><div><p>x</p>y<p>z</p><br></div>"
    rows = node_table(spark.createDataFrame([(1, html)], "page_id BIGINT, html STRING")).collect()
    for r in rows:
        after = [x for x in rows if (x.parent, x.kind) == (r.parent, "element") and x.sib >= r.sib]
        want = (len(after), sum(x.tag == r.tag for x in after)) if r.kind == "element" else (0, 0)
        assert (r.sib_end, r.nth_end) == want
    assert max(r.sib_end for r in rows) == 3


def test_a_worker_holds_few_pages_at_a_time(monkeypatch):
    monkeypatch.setattr(dom, "PIECE", 1000)
    pages = ["<ul>" + "<li>x" * (i % 7) + "</ul>" for i in range(2000)]
    pages[500], pages[501], pages[1500] = "<p>long" * 5000, None, ""
    batches = [pa.array(pages[:900]), pa.array([], pa.string()), pa.array(pages[900:])]
    parts = list(dom._parse_pages(iter(batches)))
    found = [nodes for part in parts for nodes in part.to_pylist()]
    assert [len(nodes) for nodes in found] == [_size(page) for page in pages]
    assert all([n["nid"] for n in nodes] == list(range(len(nodes))) for nodes in found)
    # 1,000 bytes are a few hundred nodes at most; the long page stands alone
    assert sorted(len(part.flatten()) for part in parts)[-2] < 1000 and len(parts) > 20
    assert [len(part) for part in parts if len(part.flatten()) > 9000] == [1]


def _size(page):
    def count(node):
        return 1 + sum(map(count, node.children))

    return 0 if page is None else count(parse_html(page))


def test_a_worker_is_sent_few_pages_at_a_time(spark):
    @F.arrow_udf("long")
    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([batch.nbytes] * len(batch))

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    pages = spark.range(0, 2000, 1, 1).select(F.rpad(F.col("id").cast("string"), 5000, "x").alias("html"))
    try:
        for limit, most in (("256m", dom.SENT), ("1g", dom.SENT), ("100kB", 100 << 10)):
            spark.conf.set(name, limit)
            assert dom.with_nodes(pages).count() == 2000
            sent = pages.select(held("html").alias("n")).agg(F.max("n"), F.count("n")).first()
            assert sent[0] < 1.2 * most and sent[1] == 2000
    finally:
        spark.conf.unset(name)
