"""Link source configuration: reading, checks and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner.functions import schedules, selectors, urls, values as v
from gleaner.sources.tables import broadcast_if_small

_FIELDS = (
    "name STRING, url STRING, itemSelector STRING, captionSelector STRING, linkSelector STRING, "
    "maxItems STRING, minElementWords STRING"
)
_FILE = (
    "email MAP<STRING, STRING>, "
    "scraping STRUCT<storageDir: STRING, schedule: STRING, linkExpiryDays: STRING>, "
    f"link_sources ARRAY<STRUCT<{_FIELDS}>>"
)


def read_config_file(spark: SparkSession, path: str) -> DataFrame:
    """Raw link sources of a JSON configuration file, in file order."""
    conf = spark.read.schema(_FILE).option("multiLine", True).json(path)
    return conf.select(F.posexplode("link_sources").alias("src_ord", "s")).select(
        F.col("src_ord").cast("bigint").alias("src_ord"), "s.*"
    )


def read_scraping(spark: SparkSession, path: str) -> DataFrame:
    """Scraping settings of a JSON configuration file, checked, with defaults."""
    conf = spark.read.schema(_FILE).option("multiLine", True).json(path)
    return check_scraping(conf.select("scraping.*"))


def read_source_table(spark: SparkSession, path: str) -> DataFrame:
    """Raw link sources from a JSON-lines table (for very many sources)."""
    return spark.read.schema(f"src_ord BIGINT, {_FIELDS}").json(path)


def is_integer(text: Column) -> Column:
    return text.rlike(r"^[+-]?[0-9]+\z") & text.try_cast("bigint").isNotNull()


def _bad_count(text: Column) -> Column:
    return text.isNotNull() & (~is_integer(text) | (text.try_cast("bigint") < 0))


def _bad_selector(text: Column) -> Column:
    return text.isNotNull() & ~selectors.is_valid(text)


def config_error(raw: DataFrame) -> Column:
    """First rule a raw link source breaks, or NULL."""
    c = {name: raw[name] for name in raw.columns}
    url = F.coalesce(c["url"], F.lit(""))
    rules = [
        (~urls.source_url_valid(url), v.ERR_URL_INVALID),
        (_bad_count(c["maxItems"]), v.ERR_MAX_ITEMS),
        (_bad_selector(c["itemSelector"]), v.ERR_ITEM_SELECTOR),
        (_bad_selector(c["captionSelector"]), v.ERR_CAPTION_SELECTOR),
        (_bad_selector(c["linkSelector"]), v.ERR_LINK_SELECTOR),
        (_bad_count(c["minElementWords"]), v.ERR_MIN_WORDS),
    ]
    checks = check_error(
        url, F.coalesce(c["name"], F.lit("")), c["itemSelector"], c["captionSelector"],
        c["linkSelector"],
    )
    return F.coalesce(*[F.when(broken, F.lit(msg)) for broken, msg in rules], checks)


def check_error(url: Column, name: Column, item: Column, caption: Column, link: Column) -> Column:
    """Rules on a parsed link source, in order; NULL when all hold."""
    return (
        F.when(url == "", F.lit(v.ERR_URL_MISSING))
        .when(name == "", F.lit(v.ERR_NAME_BLANK))
        .when(
            link.isNull() & (item.isNotNull() | caption.isNotNull()),
            F.lit(v.ERR_NEEDS_LINK_SELECTOR),
        )
        .when(item.isNull() != caption.isNull(), F.lit(v.ERR_ITEM_AND_CAPTION))
    )


def max_items_or_default(max_items: Column) -> Column:
    return F.when(F.coalesce(max_items, F.lit(0)) <= 0, v.DEFAULT_MAX_ITEMS).otherwise(max_items)


def min_words_or_default(min_words: Column) -> Column:
    """An explicit 0 stays."""
    return F.coalesce(min_words, F.lit(v.DEFAULT_MIN_ELEMENT_WORDS))


def expiry_or_default(days: Column) -> Column:
    return F.when(F.coalesce(days, F.lit(0)) == 0, v.DEFAULT_EXPIRY_DAYS).otherwise(days)


def link_sources(raw: DataFrame) -> DataFrame:
    """Raw link sources with their first error (NULL for usable ones), typed
    and with defaults."""
    count = lambda name, default: default(raw[name].try_cast("bigint"))
    return raw.select(
        # names need not differ, places in the list do
        raw["src_ord"].cast("string").alias("src"),
        raw["name"].alias("name"),
        raw["url"].alias("url"),
        raw["itemSelector"].alias("item_selector"),
        raw["captionSelector"].alias("caption_selector"),
        raw["linkSelector"].alias("link_selector"),
        count("maxItems", max_items_or_default).cast("int").alias("max_items"),
        count("minElementWords", min_words_or_default).cast("int").alias("min_element_words"),
        raw["src_ord"].alias("src_ord"),
        config_error(raw).alias("error"),
    )


def with_unique_keys(sources: DataFrame) -> DataFrame:
    """Sources whose key another one has too get an error, as their pages can't
    be told apart."""
    repeated = sources.groupBy("src").agg(F.count("*").alias("_n")).filter("_n > 1")
    marked = sources.join(broadcast_if_small(repeated), "src", "left")
    again = F.when(F.col("_n").isNotNull(), F.lit(v.ERR_REPEATED_KEY))
    return marked.withColumn("error", F.coalesce("error", again)).drop("_n").select(sources.columns)


def usable(sources: DataFrame) -> DataFrame:
    return sources.filter(F.col("error").isNull()).drop("error")


def check_scraping(raw: DataFrame, stateless: bool = False) -> DataFrame:
    """Settings of a run: storage path, schedule and key lifetime in days. A
    `stateless` run (one-off or test) needs no storage path."""
    days = raw["linkExpiryDays"]
    parsed = schedules.parse(raw["schedule"])
    storage = F.lit("") if stateless else F.coalesce(raw["storageDir"], F.lit(""))
    error = F.coalesce(
        F.when(days.isNotNull() & _bad_count(days), F.lit(v.ERR_EXPIRY)),
        parsed["error"],
        F.when((storage == "") & F.lit(not stateless), F.lit(v.ERR_STORAGE)),
    )
    return raw.select(
        storage.alias("storage_dir"),
        expiry_or_default(days.try_cast("bigint")).alias("link_expiry_days"),
        parsed["weekdays"].alias("weekdays"),
        parsed["hour"].alias("hour"),
        error.alias("error"),
    )
