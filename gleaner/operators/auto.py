"""Items of a page from its repeating link containers.

The expressions are the same for every plan, as they name columns only, so each
is built once per process: building takes longer than Spark's own planning.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import urls, values as v
from gleaner.operators.captions import caption
from gleaner.operators.links import highest_containers, link_groups


@cache
def _groups() -> Column:
    return link_groups(F.col("nodes"), F.col("links"))


@cache
def _containers() -> Column:
    return highest_containers(F.col("nodes"), F.col("groups"))


@cache
def _captions() -> Column:
    return F.transform(
        "containers",
        lambda x: F.struct(
            x.link_nid.alias("ord"),
            x.container_nid.alias("container_nid"),
            x.href.alias("href"),
            caption(F.col("nodes"), x.container_nid, F.col("min_element_words")).alias("caption"),
        ),
    )


@cache
def _rows() -> Column:
    scheme, host = urls.scheme(F.col("url")), urls.host(F.col("url"))
    return F.transform(
        "captions",
        lambda r: F.struct(
            r.ord.alias("ord"),
            F.when(r.href.isNotNull(), urls.display_url(scheme, host, r.href)).alias("link_url"),
            r.caption.alias("caption"),
            r.href.isNotNull().alias("has_href"),
        ),
    )


@cache
def _found() -> Column:
    faults = F.transform(
        "rows",
        lambda r: F.when(r.caption.isNull(), F.lit(v.MSG_BODY)).when(
            r.has_href & r.link_url.isNull(), F.lit(v.MSG_BAD_LINK_URL)
        ),
    )
    no_match = F.when(
        F.size("links") == 0, F.array(F.format_string(v.MSG_NO_MATCH, F.col("url")))
    ).otherwise(F.array().cast("array<string>"))
    good = F.filter("rows", lambda r: r.caption.isNotNull() & r.link_url.isNotNull())
    items = F.transform(
        F.sort_array(good),
        lambda r: F.struct(
            r.ord.alias("ord"), r.link_url.alias("link_url"), r.caption.alias("caption")
        ),
    )
    found = F.struct(
        items.alias("items"), F.concat(no_match, F.array_compact(faults)).alias("messages")
    )
    return F.when(F.col("links").isNotNull(), found)


def with_containers(df: DataFrame, links: Column) -> DataFrame:
    """Add `links` (nids), `groups` and `containers` to rows with `nodes`.

    One column per step: each is computed once and used by the next.
    """
    return (
        df.withColumn("links", links)
        .withColumn("groups", _groups())
        .withColumn("containers", _containers())
    )


def with_captions(df: DataFrame) -> DataFrame:
    """Add `captions`: ARRAY<STRUCT<ord, container_nid, href, caption>>, one per
    link with a container; the caption is NULL for body."""
    return df.withColumn("captions", _captions())


def with_auto(df: DataFrame, links: Column) -> DataFrame:
    """Add `auto`: STRUCT<items, messages> of each page, items in document order.

    `links` are the nids to look at; a NULL skips the page.
    """
    rows = with_captions(with_containers(df, links)).withColumn("rows", _rows())
    return rows.withColumn("auto", _found()).drop(
        "links", "groups", "containers", "captions", "rows"
    )
