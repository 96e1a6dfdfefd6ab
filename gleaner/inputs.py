"""How the sample tables stand in for sources, fetched pages, feeds, schedules,
ticks and the seen store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleaner.operators import store
from gleaner.operators.items import explode_items, with_key
from gleaner.plans.source_sets import source_sets
from gleaner.sources import dom
from gleaner.sources.tables import written

NOW = "2024-12-01 00:00:00"
EXPIRY_DAYS = 180


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return dom.spread(table(spark, sf, "pages"), "page_id")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return dom.spread(table(spark, sf, "documents"), "doc_id")


def by_turns(key: str, choices: list) -> "F.Column":
    """choices[key mod len(choices)] as a column; None is NULL."""
    n = F.col(key) % len(choices)
    out = F.when(n == 0, F.lit(choices[0]))
    for i, choice in enumerate(choices[1:], 1):
        out = out.when(n == i, F.lit(choice))
    return out


def sources(spark: SparkSession, sf: str, **settings) -> DataFrame:
    """One source per page. `settings` overrides or adds columns."""
    columns = {
        "src": F.col("page_id").cast("string"),
        "name": F.concat(F.lit("Site "), F.col("page_id").cast("string")),
        "url": F.col("url"),
        "max_items": F.lit(0),
        "min_element_words": F.lit(0),
        "src_ord": F.col("page_id"),
        **settings,
    }
    return table(spark, sf, "pages").select(*[c.alias(n) for n, c in columns.items()])


STATUS = [404, 503, 429, 400, 301, 200, 200, 200, 200, 200]


def fetched(spark: SparkSession, sf: str, status=None) -> DataFrame:
    """One fetched page per source, with mixed response codes."""
    status = by_turns("page_id", STATUS) if status is None else status
    return pages(spark, sf).select(
        F.col("page_id").cast("string").alias("src"), status.cast("int").alias("status"), "html"
    )


def page_rows(spark: SparkSession, sf: str, status=None, **settings) -> DataFrame:
    """Sources together with their pages, from one scan."""
    columns = {
        "src": F.col("page_id").cast("string"),
        "name": F.concat(F.lit("Site "), F.col("page_id").cast("string")),
        "max_items": F.lit(0),
        "min_element_words": F.lit(0),
        "src_ord": F.col("page_id"),
        "status": F.lit(200) if status is None else status.cast("int"),
        "fetched": F.lit(True),
        **settings,
    }
    return pages(spark, sf).select(
        "page_id", "url", "html", *[c.alias(n) for n, c in columns.items()]
    )


def sets(spark: SparkSession, sf: str, **settings) -> DataFrame:
    return source_sets(page_rows(spark, sf, **settings))


def written_sets(spark: SparkSession, sf: str, **settings) -> DataFrame:
    """Source sets as a written table, for queries that use them more than once."""
    return written(sets(spark, sf, **settings), "sets")


def seen_from(all_sets: DataFrame) -> DataFrame:
    """A store with the keys of all items, first seen on twelve days over a year."""
    items = with_key(explode_items(all_sets))
    day = (F.col("src_ord") % 12 * 30).cast("int")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(days=day)
    return items.groupBy("link_key").agg(F.min(at).alias("seen_at"))


# XML has no other control characters than tabs and line ends
_NOT_XML = r"[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]"


def feed_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document, as the entries of one feed: `doc_id`, `lines`
    ARRAY<STRUCT<ord, title, description>>. Short lines have no title."""
    clean = F.regexp_replace("text", _NOT_XML, "")
    lines = F.transform(
        F.split(clean, "\n"),
        lambda t, i: F.struct(
            i.alias("ord"),
            F.when(F.length(t) > 20, t).otherwise("").alias("title"),
            F.concat(F.lit("Line: "), t).alias("description"),
        ),
    )
    return documents(spark, sf).select("doc_id", lines.alias("lines"))


def _xml(c):
    for plain, escaped in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]:
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def _title(c):
    """Every third feed is written carelessly."""
    loose = (F.col("doc_id") % 3 == 0) & (c != "")
    return F.concat(_xml(c), F.when(loose, "&nbsp;R&D &rsquo;x&rsquo;").otherwise(""))


def _link(ord_):
    return F.concat(
        F.lit("http://feed.example.org/"), F.col("doc_id").cast("string"),
        F.lit("?line="), ord_.cast("string"), F.lit("&amp;x=1"),
    )


def rss_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One RSS body per document: `doc_id, html`."""
    items = F.transform(
        "lines",
        lambda e: F.concat(
            F.lit("<item><title>"), _title(e.title), F.lit("</title><link>"), _link(e.ord),
            F.lit("</link><description>"), _xml(e.description), F.lit("</description></item>"),
        ),
    )
    return feed_lines(spark, sf).select(
        "doc_id",
        F.concat(
            F.lit('<?xml version="1.0"?>\n<rss version="2.0">\n<channel><title>f</title>'),
            F.array_join(items, "\n"),
            F.lit("</channel></rss>"),
        ).alias("html"),
    )


def atom_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """One Atom body per document; each entry has a self link before its own."""
    entries = F.transform(
        "lines",
        lambda e: F.concat(
            F.lit("<entry><title>"), _title(e.title),
            F.lit('</title><link rel="self" href="http://self.example.org/"/><link href="'),
            _link(e.ord), F.lit('"/><summary>'), _xml(e.description), F.lit("</summary></entry>"),
        ),
    )
    return feed_lines(spark, sf).select(
        "doc_id",
        F.concat(
            F.lit('<?xml version="1.0"?>\n<feed xmlns="http://www.w3.org/2005/Atom">\n'),
            F.array_join(entries, "\n"),
            F.lit("</feed>"),
        ).alias("html"),
    )


SCHEDULES = ["MWF 12", "TuTh 9", "SaSu 20", "M 8", "MM 15", "WMTu 13", "MTW 12", "12 MT", "M",
             "MTuWThFSaSu 0"]


def schedules(spark: SparkSession, sf: str) -> DataFrame:
    """One schedule text per customer: `handle, schedule`."""
    return table(spark, sf, "customer").select(
        F.concat(F.lit("digest-"), F.col("c_custkey").cast("string")).alias("handle"),
        by_turns("c_custkey", SCHEDULES).alias("schedule"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))


def alive_seen(all_sets: DataFrame) -> DataFrame:
    return store.alive(seen_from(all_sets), NOW, EXPIRY_DAYS)
