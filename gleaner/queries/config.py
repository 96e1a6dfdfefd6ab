"""Link source configuration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.functions import urls, values as v
from gleaner.queries import sql
from gleaner.queries.registry import query
from gleaner.sources import configs

# URL and whether it is a valid source URL; None is the URL of the page
_URLS = [
    (None, True), ("http://www.example.com/path", True), ("localhost:3000", True),
    ("http://www.example", True), ("www.example.com", False), ("localhost", False),
    ("/path", False), ("", False), ("http://#", False), ("http://www.example test.com", False),
    ("http://[::1]:80/x", True), ("http://host:port/", False), ("http://h/%zz", False),
]


@query(
    "url_validation",
    f"SELECT page_id, CAST({sql.by_turns('page_id', [int(ok) for _, ok in _URLS])} AS BOOLEAN) "
    "AS valid FROM pages",
)
def url_validation(spark, sf):
    url = F.coalesce(inputs.by_turns("page_id", [u for u, _ in _URLS]), F.col("url"))
    return inputs.table(spark, sf, "pages").select(
        "page_id", urls.source_url_valid(url).alias("valid")
    )


# fields that differ from a correct URL-only source, and the error they give
_CASES = [
    ({}, None),
    ({"maxItems": "10", "minElementWords": "0"}, None),
    ({"linkSelector": "div ul li:nth-of-type(3)"}, None),
    ({"itemSelector": "ul li", "captionSelector": "p", "linkSelector": "a"}, None),
    ({"url": "www.example.com"}, v.ERR_URL_INVALID),
    ({"url": ""}, v.ERR_URL_INVALID),
    ({"name": ""}, v.ERR_NAME_BLANK),
    ({"maxItems": "-1"}, v.ERR_MAX_ITEMS),
    ({"maxItems": "many"}, v.ERR_MAX_ITEMS),
    ({"minElementWords": "2.5"}, v.ERR_MIN_WORDS),
    ({"itemSelector": "div:not()", "linkSelector": "a"}, v.ERR_ITEM_SELECTOR),
    ({"captionSelector": "123", "linkSelector": "a"}, v.ERR_CAPTION_SELECTOR),
    ({"linkSelector": "duv il la:uth-of-type(3)"}, v.ERR_LINK_SELECTOR),
    ({"itemSelector": "li", "captionSelector": "p"}, v.ERR_NEEDS_LINK_SELECTOR),
    ({"itemSelector": "li", "linkSelector": "a"}, v.ERR_ITEM_AND_CAPTION),
    ({"captionSelector": "p", "linkSelector": "a"}, v.ERR_ITEM_AND_CAPTION),
    ({"maxItems": "0"}, None),
]


def _field(name, default):
    given = inputs.by_turns("page_id", [case.get(name) for case, _ in _CASES])
    return F.coalesce(given, default).alias(name)


def raw_sources(spark, sf):
    none = F.lit(None).cast("string")
    return inputs.table(spark, sf, "pages").select(
        F.col("page_id").alias("src_ord"),
        _field("name", F.concat(F.lit("Site "), F.col("page_id").cast("string"))),
        _field("url", F.col("url")),
        *[
            _field(name, none)
            for name in (
                "itemSelector", "captionSelector", "linkSelector", "maxItems", "minElementWords"
            )
        ],
    )


@query(
    "config_errors",
    f"SELECT page_id, {sql.by_turns('page_id', [e for _, e in _CASES])} AS error FROM pages",
)
def config_errors(spark, sf):
    raw = raw_sources(spark, sf)
    return raw.select(F.col("src_ord").alias("page_id"), configs.config_error(raw).alias("error"))


def _sql_field(name):
    return sql.by_turns("page_id", [case.get(name) for case, _ in _CASES])


@query(
    "link_sources",
    f"""SELECT page_id AS src_ord, 'Site ' || page_id AS name, url,
        {_sql_field('itemSelector')} AS item_selector,
        {_sql_field('captionSelector')} AS caption_selector,
        {_sql_field('linkSelector')} AS link_selector,
        CASE WHEN coalesce(CAST({_sql_field('maxItems')} AS INTEGER), 0) = 0 THEN 5
             ELSE CAST({_sql_field('maxItems')} AS INTEGER) END AS max_items,
        coalesce(CAST({_sql_field('minElementWords')} AS INTEGER), 3) AS min_element_words
        FROM pages WHERE {sql.by_turns('page_id', [int(e is None) for _, e in _CASES])} = 1""",
)
def link_sources(spark, sf):
    return configs.usable(configs.link_sources(raw_sources(spark, sf))).drop("src")


@query(
    "config_defaults",
    """SELECT p_partkey,
       CASE WHEN p_size % 4 = 0 THEN 5 ELSE p_size % 4 END AS max_items,
       CASE WHEN p_size % 3 = 0 THEN 3 ELSE p_size % 3 - 1 END AS min_element_words,
       CASE WHEN p_size % 5 = 0 THEN 180 ELSE p_size % 5 END AS expiry_days FROM part""",
)
def config_defaults(spark, sf):
    size = F.col("p_size")
    min_words = F.when(size % 3 != 0, size % 3 - 1)
    return inputs.table(spark, sf, "part").select(
        "p_partkey",
        configs.max_items_or_default(size % 4).alias("max_items"),
        configs.min_words_or_default(min_words).alias("min_element_words"),
        configs.expiry_or_default(size % 5).alias("expiry_days"),
    )
