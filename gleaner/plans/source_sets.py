"""From fetched pages to one link set per source.

One narrow stage: scan, one Arrow UDF that parses HTML, then column expressions.
A page and all that is derived from it stay in one row of one task, so nothing
is shuffled here whatever the number of pages, and no source can be a hot key.
Only the resulting items, a few short strings per page, move on.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from gleaner.functions import selectors, values as v
from gleaner.functions.text import let, trim_any
from gleaner.operators import auto, manual
from gleaner.operators.links import anchors
from gleaner.sources import dom, feeds, pages
from gleaner.sources.tables import broadcast_if_small

_SETTINGS = ["src", "name", "url", "max_items", "min_element_words", "src_ord"]
_SELECTORS = ["item_selector", "caption_selector", "link_selector"]


def newest_pages(fetched: DataFrame) -> DataFrame:
    """The newest page of each source, where pages have a `fetched_at` (NULL is
    the oldest). Only keys and times are aggregated, and sent to the pages when
    they are small; page texts stay where they were read."""
    if "fetched_at" not in fetched.columns:
        return fetched
    at = F.coalesce(F.col("fetched_at"), F.timestamp_seconds(F.lit(0)))
    times = fetched.groupBy("src").agg(F.max(at).alias("_at"))
    return fetched.withColumn("_at", at).join(broadcast_if_small(times), ["src", "_at"], "left_semi").drop("_at")


def source_pages(sources: DataFrame, fetched: DataFrame, missing: bool = True) -> DataFrame:
    """Each source with its newest fetched page. Sources without a page stay,
    with `fetched` false, unless `missing` says that they have no part in this.

    Page texts stay where they were read when the sources, measured, are small
    enough to be broadcast; otherwise the join is shuffled, and adaptive
    execution splits skewed partitions. Sources without a page come from an
    anti join that reads the `src` column only.

    Selector columns are optional: sources without any need no selector work in
    the plan.
    """
    settings = sources.select(*_SETTINGS, *[c for c in _SELECTORS if c in sources.columns])
    body = newest_pages(fetched).select("src", "status", "html")
    got = body.join(broadcast_if_small(settings), "src").withColumn("fetched", F.lit(True))
    if not missing:
        return got
    rest = (
        settings.join(fetched.select("src"), "src", "left_anti")
        .withColumn("status", F.lit(None).cast("int"))
        .withColumn("html", F.lit(None).cast("string"))
        .withColumn("fetched", F.lit(False))
    )
    return got.unionByName(rest)


def _setting(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def with_route(source_pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Decide how to read each page. Pages are cut only where `max_bytes` says so."""
    capped = source_pages
    if max_bytes is not None:
        capped = source_pages.withColumns(
            {
                "cut": F.octet_length("html") > max_bytes,
                "html": pages.cap_page(F.col("html"), max_bytes),
            }
        )
    return capped.withColumn(
        "route",
        pages.page_route(
            F.col("html"),
            F.col("status"),
            _setting(capped, "item_selector"),
            _setting(capped, "caption_selector"),
        ),
    )


def detected(routed: DataFrame) -> DataFrame:
    """Add `found`: STRUCT<items, messages> of the detector of each route, items
    in document order, before dedupe and caps."""
    c = F.col
    # feeds are read before the page text is given up for the node array
    parsed = dom.with_nodes(
        routed.withColumn("feed", _feed()), "html", c("route").isin("html", "manual")
    ).drop("html")

    # nids are NULL, and the detectors idle, on pages of another route
    all_links, by_hand = _anchors(), F.lit(False)
    if "link_selector" in routed.columns:
        parsed = parsed.withColumn("selected", _select("link_selector"))
        all_links = F.when(c("link_selector").isNull(), all_links).otherwise(c("selected"))
        by_hand = (c("route") == "manual") & c("link_selector").isNotNull()
    read = auto.with_auto(parsed, F.when(c("route") == "html", all_links))
    found = (
        F.when(c("route") == "html", c("auto"))
        .when(c("route").isin("rss", "atom"), c("feed"))
        .when(c("route") == "unknown", _nothing(F.lit(v.MSG_NO_FORMAT)))
    )
    if all(name in routed.columns for name in _SELECTORS):
        read = manual.with_manual(
            read,
            F.when(by_hand, _select("item_selector")),
            F.when(by_hand, c("selected")),
            F.when(by_hand, _select("caption_selector")),
        )
        found = found.when(by_hand, c("manual"))
    found = found.when(c("route") == "manual", _nothing(F.lit(v.MSG_NO_LINK_SELECTOR)))
    return read.withColumn("found", found.otherwise(_nothing())).drop(
        "nodes", "feed", "selected", "auto", "manual"
    )


@cache
def _select(selector: str) -> Column:
    return selectors.select(F.col("nodes"), selectors.parse(F.col(selector)))


@cache
def _anchors() -> Column:
    return anchors(F.col("nodes"))


@cache
def _feed() -> Column:
    route, body = F.col("route"), F.col("html")
    return F.when(route == "rss", feeds.rss_items(body)).when(
        route == "atom", feeds.atom_items(body)
    )


def _nothing(*messages: Column) -> Column:
    return F.struct(
        F.array().cast("array<struct<ord: int, link_url: string, caption: string>>").alias("items"),
        F.array(*messages).cast("array<string>").alias("messages"),
    )


def latest_by_url(items: Column) -> Column:
    """One item per URL, the last one in order, still in order."""

    def keep_first_of_run(rows):
        return F.filter(
            rows, lambda r, i: (i == 0) | (F.get(rows, i - 1).link_url != r.link_url)
        )

    by_url = F.sort_array(
        F.transform(
            items,
            lambda x: F.struct(
                x.link_url.alias("link_url"), (-x.ord).alias("back"), x.caption.alias("caption")
            ),
        )
    )
    return F.sort_array(
        F.transform(
            let(by_url, keep_first_of_run),
            lambda r: F.struct(
                (-r.back).alias("ord"), r.link_url.alias("link_url"), r.caption.alias("caption")
            ),
        )
    )


@cache
def _clean() -> Column:
    return F.filter(latest_by_url(F.col("items")), lambda x: trim_any(x.caption) != "")


def with_finished_items(df: DataFrame) -> DataFrame:
    """Set `items`: deduped by URL, without blank captions, then cut to the limit
    of the source (0 = none)."""
    return df.withColumn("items", _clean()).withColumn(
        "items",
        F.when(
            F.col("max_items") > 0, F.slice("items", F.lit(1), F.col("max_items"))
        ).otherwise(F.col("items")),
    )


def source_sets(source_pages: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """One row per source: `src, src_ord, name, items, messages`.

    `name` is empty when no page body could be read. A page that was cut after
    `max_bytes` bytes has a message about it.
    """
    c = F.col
    sets = detected(with_route(source_pages, max_bytes))
    response = F.when(
        c("route") == "none", F.array(F.lit(v.MSG_NULL_PAGE))
    ).otherwise(F.array_compact(F.array(pages.status_message(c("status")))))
    if max_bytes is not None:
        told = F.array(F.lit(v.MSG_CUT_PAGE % max_bytes))
        response = F.when(c("cut"), F.concat(response, told)).otherwise(response)
    # a failed fetch has no body either, but the source keeps its name
    name = F.when((c("route") == "none") & c("fetched"), F.lit("")).otherwise(c("name"))
    found = sets.select(
        "src",
        "src_ord",
        name.alias("name"),
        "max_items",
        c("found.items").alias("items"),
        F.concat(response, c("found.messages")).alias("messages"),
    )
    return with_finished_items(found).drop("max_items")
