"""From page text to links, containers and captions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from gleaner import inputs
from gleaner.functions import selectors, values as v
from gleaner.functions.text import let
from gleaner.operators import auto, captions, links, manual
from gleaner.plans.source_sets import detected, with_route
from gleaner.queries import sql
from gleaner.queries.registry import query
from gleaner.sources import dom

_A = f"WITH {sql.ANCHORS}"


def _nodes(spark, sf):
    return dom.with_nodes(inputs.pages(spark, sf))


def _rows(df, array, *keep):
    """Elements of an array column as rows; outer, so that Spark infers no
    filter that would compute the array a second time."""
    out = df.select(*keep, F.posexplode_outer(array).alias("pos", "x"))
    return out.filter(F.col("x").isNotNull())


@query("dom_nodes")
def dom_nodes(spark, sf):
    nodes = dom.node_table(inputs.pages(spark, sf).select("page_id", "html")).drop("sib_end", "nth_end")
    return nodes.withColumn("attrs", F.to_json("attrs")).withColumnRenamed("last", "last_nid")


@query(
    "dom_anchors",
    f"{_A} SELECT page_id, count(*) AS n_anchors, min(5) AS min_depth, max(5) AS max_depth "
    "FROM anchors GROUP BY page_id",
)
def dom_anchors(spark, sf):
    anchors = F.filter("nodes", lambda n: links.is_element(n) & (n.tag == "a"))
    depths = F.transform(anchors, lambda n: n.depth)
    return (
        _nodes(spark, sf)
        .select("page_id", depths.alias("d"))
        .select(
            "page_id",
            F.size("d").cast("bigint").alias("n_anchors"),
            F.array_min("d").alias("min_depth"),
            F.array_max("d").alias("max_depth"),
        )
    )


@query("node_depth", f"{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos, 5 AS depth FROM anchors")
def node_depth(spark, sf):
    anchors = F.filter("nodes", lambda n: links.is_element(n) & (n.tag == "a"))
    depths = F.transform(anchors, lambda n: F.size(links.path_to(F.col("nodes"), n.nid)) - 1)
    return _rows(_nodes(spark, sf), depths, "page_id").withColumnRenamed("x", "depth")


@query(
    "inline_tags",
    f"""{_A}, counts AS (SELECT page_id, count(*) AS n FROM anchors GROUP BY page_id)
        SELECT page_id, 'a' AS tag, true AS is_inline, n FROM counts
        UNION ALL SELECT page_id, 'li', false, n FROM counts
        UNION ALL SELECT page_id, 'ul', false, 1 FROM counts
        UNION ALL SELECT page_id, 'nav', false, 1 FROM counts""",
)
def inline_tags(spark, sf):
    wanted = F.filter("nodes", lambda n: n.tag.isin("a", "li", "ul", "nav"))
    tags = _rows(_nodes(spark, sf), F.transform(wanted, lambda n: n.tag), "page_id")
    counts = tags.groupBy("page_id", F.col("x").alias("tag")).agg(F.count("*").alias("n"))
    return counts.withColumn("is_inline", links.inline(F.col("tag")))


@query(
    "parent_child",
    f"{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos, 'a' AS child, 'li' AS parent FROM anchors",
)
def parent_child(spark, sf):
    pairs = F.transform(
        F.filter("nodes", lambda n: links.is_element(n) & (n.tag == "a")),
        lambda n: F.struct(
            n.tag.alias("child"), links.node_at(F.col("nodes"), n.parent).tag.alias("parent")
        ),
    )
    return _rows(_nodes(spark, sf), pairs, "page_id").select("page_id", "pos", "x.*")


@query(
    "subtree_nodes",
    f"""{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN txt = '' THEN 2 ELSE 3 END AS n_nodes,
        txt AS text FROM anchors""",
)
def subtree_nodes(spark, sf):
    nodes = F.col("nodes")
    items = F.transform(
        F.filter(nodes, lambda n: links.is_element(n) & (n.tag == "li")),
        lambda n: let(
            captions.subtree(nodes, n.nid),
            lambda below: F.struct(
                F.size(below).alias("n_nodes"),
                F.array_join(F.transform(below, lambda b: F.coalesce(b.txt, F.lit(""))), "").alias(
                    "text"
                ),
            ),
        ),
    )
    return _rows(_nodes(spark, sf), items, "page_id").select("page_id", "pos", "x.*")


@query("link_hrefs", f"{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM anchors")
def link_hrefs(spark, sf):
    hrefs = F.transform(
        links.anchors(F.col("nodes")),
        lambda nid: F.element_at(links.node_at(F.col("nodes"), nid).attrs, "href"),
    )
    return _rows(_nodes(spark, sf), hrefs, "page_id").withColumnRenamed("x", "href")


_SELECTORS = {
    "a": "n", "nav > ul > li": "n", "li ~ li": "n - 1", "li + li a": "n - 1", "a[href]": "n",
    "table": "0", "ul, a": "n + 1", "li:nth-of-type(2) a": "1", "body nav a": "n", "ul > a": "0",
    "A[HREF]": "n", "li:nth-child(odd) a": "(n + 1) // 2", "li:nth-child(2n) a": "n // 2",
    "li:last-child a": "1", "li:nth-of-type(-n+2) a": "least(n, 2)", "a:not([href])": "0",
    "li:not(.x) > a": "n", "a[title!=\"x, y\"]": "n", "li:only-child": "CAST(n = 1 AS INTEGER)",
    "nav a:only-child": "n", "li:nth-last-child(2) a": "CAST(n > 1 AS INTEGER)",
    "li:nth-last-of-type(odd) > a": "(n + 1) // 2", "li:nth-last-child(-n+3)": "least(n, 3)",
    "nav:has(a) li": "n", "li:has(a[href])": "n", "ul:has(li) > li:last-of-type": "1",
    "li:has(ul), a:has(*)": "0", "nav:has(.a\\:b) a": "0", "li:nth-last-child(2) ~ li": "CAST(n > 1 AS INTEGER)",
}


@query(
    "css_select",
    f"{_A}, counts AS (SELECT page_id, count(*) AS n FROM anchors GROUP BY page_id) "
    + " UNION ALL ".join(
        f"SELECT page_id, '{s}' AS selector, CAST({n} AS BIGINT) AS n_matches FROM counts"
        for s, n in _SELECTORS.items()
    ),
)
def css_select(spark, sf):
    # parsed once and sent to the pages, whose nodes stay one row
    texts = spark.createDataFrame([(s,) for s in _SELECTORS], "selector STRING")
    parsed = texts.select(F.collect_list(F.struct("selector", selectors.parse(F.col("selector")).alias("steps"))).alias("wanted"))
    nodes = F.col("nodes")
    counts = F.transform(
        "wanted",
        lambda w: F.struct(
            w.selector.alias("selector"),
            F.size(selectors.select(nodes, w.steps, F.col("elements"))).cast("bigint").alias("n_matches"),
        ),
    )
    pages = _nodes(spark, sf).select("page_id", "nodes", F.filter(nodes, links.is_element).alias("elements"))
    found = pages.crossJoin(F.broadcast(parsed))
    return found.select("page_id", F.explode(counts).alias("x")).select("page_id", "x.*")


@query(
    "css_nth_of_type",
    f"{_A} SELECT page_id, CAST(pos + 1 AS INTEGER) AS nth, href FROM anchors",
)
def css_nth_of_type(spark, sf):
    nodes = F.col("nodes")
    items = F.transform(
        F.filter(nodes, lambda n: links.is_element(n) & (n.tag == "li")),
        lambda n: F.struct(
            n.nth.alias("nth"),
            F.element_at(links.node_at(nodes, n.nid + 1).attrs, "href").alias("href"),
        ),
    )
    return _rows(_nodes(spark, sf), items, "page_id").select("page_id", "x.*")


def _contained(spark, sf):
    return auto.with_containers(_nodes(spark, sf), links.anchors(F.col("nodes")))


@query(
    "link_groups",
    f"{_A} SELECT page_id, md5('aliulnav') AS sig, count(*) AS n_links, 5 AS min_depth "
    "FROM anchors GROUP BY page_id",
)
def link_groups(spark, sf):
    groups = F.transform(
        "groups",
        lambda g: F.struct(
            g.sig.alias("sig"),
            F.size(g.links).cast("bigint").alias("n_links"),
            g.min_depth.alias("min_depth"),
        ),
    )
    return _rows(_contained(spark, sf), groups, "page_id").select("page_id", "x.*")


_LEVELS = f"""{_A}, counts AS (SELECT page_id, count(*) AS n FROM anchors GROUP BY page_id)
  SELECT page_id, md5('aliulnav') AS sig, CAST(level AS INTEGER) AS level, n AS n_containers,
         level <= 1 AS repeating FROM counts, (SELECT unnest(range(0, 5)) AS level)"""


def _levels(spark, sf):
    nodes = F.col("nodes")
    levels = F.flatten(
        F.transform(
            "groups",
            lambda g: F.transform(
                links.container_levels(nodes, g),
                lambda x: F.struct(
                    g.sig.alias("sig"),
                    x.level.alias("level"),
                    x.repeating.alias("repeating"),
                    F.transform(
                        x.containers,
                        lambda c: F.struct(
                            c.alias("nid"), links.atom(links.node_at(nodes, c).tag).alias("tag")
                        ),
                    ).alias("containers"),
                ),
            ),
        )
    )
    return _rows(_contained(spark, sf), levels, "page_id").select("page_id", "x.*")


@query("container_levels", _LEVELS)
def container_levels(spark, sf):
    n = F.size("containers").cast("bigint")
    return _levels(spark, sf).select("page_id", "sig", "level", n.alias("n_containers"), "repeating")


@query("container_levels_window", _LEVELS)
def container_levels_window(spark, sf):
    """The same by comparing each container with its neighbour."""
    each = _levels(spark, sf).select(
        "page_id", "sig", "level", F.posexplode("containers").alias("pos", "c")
    )
    ahead = F.lead("c").over(Window.partitionBy("page_id", "sig", "level").orderBy("pos"))
    differs = (F.col("next.nid") != F.col("c.nid")) & (F.col("next.tag") == F.col("c.tag"))
    return (
        each.withColumn("next", ahead)
        .groupBy("page_id", "sig", "level")
        .agg(
            F.count("*").alias("n_containers"),
            F.every(F.coalesce(differs, F.col("next").isNull())).alias("repeating"),
        )
    )


@query(
    "highest_containers",
    f"{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos, 'li' AS container, href FROM anchors",
)
def highest_containers(spark, sf):
    found = F.transform(
        "containers",
        lambda x: F.struct(
            links.node_at(F.col("nodes"), x.container_nid).tag.alias("container"),
            x.href.alias("href"),
        ),
    )
    return _rows(_contained(spark, sf), found, "page_id").select("page_id", "pos", "x.*")


_PIECES = f"{_A}, pieces AS (SELECT *, {sql.text_piece('txt')} AS piece FROM anchors)"
_MIN_WORDS = "page_id % 3"


def _min_words():
    return (F.col("page_id") % 3).cast("int")


@query(
    "caption_text",
    f"{_PIECES} SELECT page_id, CAST(pos AS INTEGER) AS pos, "
    f"{sql.close_block('piece', _MIN_WORDS)} AS text FROM pieces",
)
def caption_text(spark, sf):
    nodes = F.col("nodes")
    texts = F.transform(
        "containers",
        lambda x: let(
            captions.subtree(nodes, x.container_nid),
            lambda below: captions.fold_text(captions.text_events(below), _min_words()),
        ),
    )
    return _rows(_contained(spark, sf), texts, "page_id").withColumnRenamed("x", "text")


@query(
    "captions_auto",
    f"{_PIECES}, blocks AS (SELECT *, {sql.close_block('piece', _MIN_WORDS)} AS block FROM pieces) "
    f"SELECT page_id, CAST(pos AS INTEGER) AS pos, "
    f"{sql.trim_any(sql.tighten(sql.truncate_words('block')))} AS caption FROM blocks",
)
def captions_auto(spark, sf):
    df = _contained(spark, sf).withColumn("min_element_words", _min_words())
    texts = F.transform("captions", lambda x: x.caption)
    return _rows(auto.with_captions(df), texts, "page_id").withColumnRenamed("x", "caption")


def _found(spark, sf, status=None, **settings):
    return detected(with_route(inputs.page_rows(spark, sf, status=status, **settings)))


def _found_items(found, *more):
    return _rows(found, F.col("found.items"), "page_id").select(
        "page_id", "pos", "x.link_url", "x.caption", *more
    )


@query(
    "items_auto",
    f"WITH {sql.RAW_ITEMS} SELECT page_id, CAST(pos AS INTEGER) AS pos, link_url, caption "
    "FROM raw_items",
)
def items_auto(spark, sf):
    return _found_items(_found(spark, sf))


_LINK_SELECTORS = ["nav a", "ul > li > a", "li:nth-of-type(2) a", "table a"]


def _link_selector():
    return inputs.by_turns("page_id", _LINK_SELECTORS)


@query(
    "items_link_selector",
    f"WITH {sql.RAW_ITEMS} SELECT page_id, CAST(pos AS INTEGER) AS pos, link_url, caption "
    "FROM raw_items WHERE page_id % 4 < 2",
)
def items_link_selector(spark, sf):
    """Sources with one of four link selectors. The third matches one link per
    page, which has no repeating container, the fourth matches nothing."""
    return _found_items(_found(spark, sf, link_selector=_link_selector()))


_NO_MATCH = v.MSG_NO_MATCH.split("%s")


@query(
    "link_selector_messages",
    f"""SELECT page_id, '{v.MSG_BODY}' AS message FROM pages WHERE page_id % 4 = 2
        UNION ALL SELECT page_id, '{_NO_MATCH[0]}' || url || '{_NO_MATCH[1]}' FROM pages
        WHERE page_id % 4 = 3""",
)
def link_selector_messages(spark, sf):
    found = _found(spark, sf, link_selector=_link_selector())
    rows = _rows(found, F.col("found.messages"), "page_id")
    return rows.select("page_id", F.col("x").alias("message"))


# link and caption selectors within `nav ul li`, and what they give
_MANUAL_LINKS = ["a", "a", "a", "*", "b", "li"]
_MANUAL_CAPTIONS = ["a", "p", "li, a", "a", "a", "a"]


def _manual(spark, sf):
    return _found(
        spark,
        sf,
        item_selector=F.lit("nav ul li"),
        link_selector=inputs.by_turns("page_id", _MANUAL_LINKS),
        caption_selector=inputs.by_turns("page_id", _MANUAL_CAPTIONS),
    )


@query(
    "items_manual",
    f"""{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos,
        {sql.scheme('url')} || '://' || {sql.host('url')} || href AS link_url,
        CASE page_id % 6 WHEN 0 THEN txt WHEN 1 THEN '' ELSE '{v.AMBIGUOUS_CAPTION}' END AS caption
        FROM anchors WHERE page_id % 6 < 3""",
)
def items_manual(spark, sf):
    return _found_items(_manual(spark, sf))


def _quoted(msg):
    return "'" + msg.replace("'", "''") + "'"


@query(
    "manual_messages",
    f"""SELECT page_id, CASE page_id % 6 WHEN 3 THEN {_quoted(v.MSG_AMBIGUOUS_LINK)}
        WHEN 4 THEN {_quoted(v.MSG_NO_LINK)} ELSE {_quoted(v.MSG_NOT_A_LINK % 'li')} END AS message
        FROM pages WHERE page_id % 6 >= 3""",
)
def manual_messages(spark, sf):
    rows = _rows(_manual(spark, sf), F.col("found.messages"), "page_id")
    return rows.select("page_id", F.col("x").alias("message"))


@query(
    "manual_match_counts",
    f"""{_A} SELECT page_id, CAST(pos AS INTEGER) AS pos,
        {sql.by_turns('page_id', [1, 1, 1, 2, 0, 1])} AS n_links,
        {sql.by_turns('page_id', [1, 0, 2, 1, 1, 1])} AS n_captions FROM anchors""",
)
def manual_match_counts(spark, sf):
    nodes = F.col("nodes")

    def found(selector):
        return selectors.select(nodes, selectors.parse(selector))

    df = manual.with_matches(
        _nodes(spark, sf),
        found(F.lit("nav ul li")),
        found(inputs.by_turns("page_id", _MANUAL_LINKS)),
        found(inputs.by_turns("page_id", _MANUAL_CAPTIONS)),
    )
    rows = _rows(df, F.col("matches"), "page_id")
    return rows.select("page_id", F.col("x.pos").alias("pos"), "x.n_links", "x.n_captions")


_ROUTE_STATUS = [200, 200, 404, 200]
_ROUTE_ITEM = ["li", None, "li", "li"]
_ROUTE_CAPTION = ["a", None, "a", None]


@query(
    "page_route",
    f"SELECT page_id, {sql.by_turns('page_id', ['manual', 'html', 'failed', 'html'])} AS route "
    "FROM pages",
)
def page_route(spark, sf):
    rows = inputs.page_rows(
        spark,
        sf,
        status=inputs.by_turns("page_id", _ROUTE_STATUS),
        item_selector=inputs.by_turns("page_id", _ROUTE_ITEM),
        caption_selector=inputs.by_turns("page_id", _ROUTE_CAPTION),
    )
    return with_route(rows).select("page_id", "route")
