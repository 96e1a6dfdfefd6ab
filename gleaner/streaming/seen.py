"""Keyed state that remembers sent items for a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gleaner.functions.values import DEFAULT_EXPIRY_DAYS


def new_items_stream(
    items: DataFrame, days: int = DEFAULT_EXPIRY_DAYS, at: str = "fetched_at"
) -> DataFrame:
    """Streaming items (`link_key, link_url, caption, src` and the time `at`)
    whose key was not seen in the `days` days before, by event time.

    The first row of a key passes and is remembered until the watermark is `days`
    days past it; later rows don't renew it. Rows older than the watermark are
    late and dropped. Of rows of one key in the same batch any one passes: they
    have the same link and caption, but may come from different sources.
    """
    rows = items.select("link_key", "link_url", "caption", "src", at)
    remembered = rows.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(["link_key"])
    return remembered.select("link_key", "link_url", "caption", "src")
