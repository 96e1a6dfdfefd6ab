"""Fetched pages: reading, response status, format and route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleaner import schemas
from gleaner.functions import values as v


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page table (parquet)."""
    return spark.read.schema(schemas.FETCHED).parquet(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """Saved page files, one page per file: `url` is the file path."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("url"), F.col("value").alias("html")
    )


def stream_pages(spark: SparkSession, path: str, schema: str = schemas.FETCHED) -> DataFrame:
    """Page files as they land in a directory."""
    return spark.readStream.schema(schema).parquet(path)


def cap_page(page: Column, max_bytes: int | None = None) -> Column:
    """Cut a page after `max_bytes` bytes (None: never), but not inside a character."""
    if max_bytes is None:
        return page
    cut = F.make_valid_utf8(F.substring(page.cast("binary"), 1, max_bytes).cast("string"))
    return F.when(
        F.octet_length(page) > max_bytes, F.regexp_replace(cut, r"\x{FFFD}\z", "")
    ).otherwise(page)


def status_message(status: Column) -> Column:
    """What to tell the reader about a response status; NULL for nothing."""
    return (
        F.when(status == 403, F.lit(v.MSG_403))
        .when(status == 404, F.lit(v.MSG_404))
        .when(status == 429, F.lit(v.MSG_429))
        .when(status == 400, F.format_string(v.MSG_400, status))
        .when(F.floor(status / 100) == 5, F.format_string(v.MSG_5XX, status))
        .when(status >= 600, F.format_string(v.MSG_600, status))
    )


def is_success(status: Column) -> Column:
    """2xx, or no status at all (0 or NULL)."""
    return status.between(200, 299) | (F.coalesce(status, F.lit(0)) == 0)


def page_format(page: Column) -> Column:
    """'html', 'rss', 'atom' or 'unknown', from the first opening tag that tells."""
    tag = F.regexp_extract(F.lower(page), v.FORMAT_TAG, 1)
    return (
        F.when(tag == "", "unknown")
        .when(F.contains(tag, F.lit("rss")), "rss")
        .when(F.contains(tag, F.lit("html")), "html")
        .otherwise("atom")
    )


def page_route(page: Column, status: Column, item_selector: Column, caption_selector: Column) -> Column:
    """How to read a page: 'none' (no body), 'failed' (bad status), 'manual'
    (both selectors given; the format does not matter then), else its format."""
    return (
        F.when(page.isNull(), "none")
        .when(~is_success(status), "failed")
        .when(item_selector.isNotNull() & caption_selector.isNotNull(), "manual")
        .otherwise(page_format(page))
    )
