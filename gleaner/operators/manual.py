"""Items of a page by three selectors: list item, link and caption."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import urls, values as v
from gleaner.functions.selectors import rank_below
from gleaner.functions.text import let
from gleaner.operators.links import node_at


def inside(nodes: Column, items: Column, matches: Column) -> Column:
    """For each item, what lies in it (itself included): ARRAY<STRUCT<n, nid>>,
    the count and the first match.

    Matches are sorted by nid and a subtree is an interval of nids, so counts
    are differences of ranks: n log n, not items x matches.
    """
    first = rank_below(matches, items)
    end = rank_below(matches, F.transform(items, lambda i: node_at(nodes, i).last + 1))
    return F.zip_with(
        first,
        end,
        lambda a, b: F.struct((b - a).alias("n"), F.when(b > a, F.get(matches, a)).alias("nid")),
    )


@cache
def _inside(matches: str) -> Column:
    return inside(F.col("nodes"), F.col("m_items"), F.col(matches))


@cache
def _matches() -> Column:
    return F.transform(
        "m_items",
        lambda item, i: F.struct(
            i.alias("pos"),
            item.alias("item_nid"),
            F.get("in_links", i).n.alias("n_links"),
            F.get("in_links", i).nid.alias("link_nid"),
            F.get("in_captions", i).n.alias("n_captions"),
            F.get("in_captions", i).nid.alias("caption_nid"),
        ),
    )


def with_matches(df: DataFrame, items: Column, links: Column, captions: Column) -> DataFrame:
    """Add `matches`: ARRAY<STRUCT<pos, item_nid, n_links, link_nid, n_captions,
    caption_nid>>, one entry per list item, in document order."""
    return (
        df.withColumns({"m_items": items, "m_links": links, "m_captions": captions})
        .withColumns({"in_links": _inside("m_links"), "in_captions": _inside("m_captions")})
        .withColumn("matches", _matches())
        .drop("m_items", "m_links", "m_captions", "in_links", "in_captions")
    )


def first_child_text(nodes: Column, nid: Column) -> Column:
    """Data of the first child: text, or the tag of an element; '' without one."""
    child = node_at(nodes, nid + 1)
    return F.when(node_at(nodes, nid).last > nid, F.coalesce(child.txt, child.tag)).otherwise("")


def read_item(nodes: Column, match: Column, scheme: Column, host: Column) -> Column:
    """STRUCT<pos, error, link_url, caption> of one list item."""
    link = node_at(nodes, match.link_nid)
    # an item without href links to the source itself
    url = urls.display_url(scheme, host, F.coalesce(F.element_at(link.attrs, "href"), F.lit("")))
    return let(
        url,
        lambda u: F.struct(
            match.pos.alias("pos"),
            F.when(match.n_links > 1, F.lit(v.MSG_AMBIGUOUS_LINK))
            .when(match.n_links == 0, F.lit(v.MSG_NO_LINK))
            .when(link.tag != "a", F.format_string(v.MSG_NOT_A_LINK, link.tag))
            .when(u.isNull(), F.lit(v.MSG_BAD_LINK_URL))
            .alias("error"),
            u.alias("link_url"),
            F.when(match.n_captions == 0, F.lit(""))
            .when(match.n_captions > 1, F.lit(v.AMBIGUOUS_CAPTION))
            .otherwise(first_child_text(nodes, match.caption_nid))
            .alias("caption"),
        ),
    )


@cache
def _rows() -> Column:
    scheme, host = urls.scheme(F.col("url")), urls.host(F.col("url"))
    return F.transform("matches", lambda m: read_item(F.col("nodes"), m, scheme, host))


@cache
def _n_good() -> Column:
    failed = F.array_position(F.transform("rows", lambda r: r.error.isNotNull()), True)
    return F.when(failed == 0, F.size("rows")).otherwise(failed - 1).cast("int")


@cache
def _found() -> Column:
    n = F.col("n_good")
    found = F.struct(
        F.transform(
            F.slice("rows", F.lit(1), n),
            lambda r: F.struct(
                r.pos.alias("ord"), r.link_url.alias("link_url"), r.caption.alias("caption")
            ),
        ).alias("items"),
        F.transform(F.slice("rows", n + 1, F.lit(1)), lambda r: r.error).alias("messages"),
    )
    return F.when(F.col("rows").isNotNull(), found)


def with_manual(df: DataFrame, items: Column, links: Column, captions: Column) -> DataFrame:
    """Add `manual`: STRUCT<items, messages>. The first faulty item ends the
    list, the items before it stay. NULL nids skip the page."""
    rows = with_matches(df, items, links, captions).withColumn("rows", _rows())
    return (
        rows.withColumn("n_good", _n_good())
        .withColumn("manual", _found())
        .drop("matches", "rows", "n_good")
    )
