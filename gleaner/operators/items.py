"""Item tables: dedupe, clean, cap, remove, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.functions.text import link_key, trim_any
from gleaner.sources.tables import broadcast_if_small


def explode_items(sets: DataFrame) -> DataFrame:
    """Items of source sets as rows `src, src_ord, ord, link_url, caption`."""
    rows = sets.select("src", "src_ord", F.explode_outer("items").alias("item"))
    return rows.filter(F.col("item").isNotNull()).select("src", "src_ord", "item.*")


def with_key(items: DataFrame) -> DataFrame:
    return items.withColumn("link_key", link_key(F.col("caption"), F.col("link_url")))


def dedupe_url(items: DataFrame) -> DataFrame:
    """One row per (src, link_url): the last one in order. Copies are merged
    before the shuffle, so many copies of one link do no harm."""
    last = F.max(F.struct("ord", "caption")).alias("last")
    return items.groupBy("src", "link_url").agg(last).select("src", "link_url", "last.*")


def clean_items(items: DataFrame) -> DataFrame:
    return items.filter(trim_any(F.col("caption")) != "")


def cap_items(items: DataFrame, spread: int = 1024) -> DataFrame:
    """The first `max_items` items of each source by `ord` (0 = all of them).

    Two steps, so that a source with a third of all rows is no single task: each
    of `spread` slices of a source is cut first, and only the survivors, at most
    `spread * max_items`, meet in one partition. Rows of sources without limit
    take no part in this.
    """
    limited = items.filter("max_items > 0")
    slice_of = F.pmod(F.xxhash64("link_url", "ord"), F.lit(spread))
    for part in (["src", "_slice"], ["src"]):
        order = Window.partitionBy(*part).orderBy("ord")
        limited = (
            limited.withColumn("_slice", slice_of)
            .withColumn("_rank", F.row_number().over(order))
            .filter("_rank <= max_items")
            .drop("_slice", "_rank")
        )
    return items.filter("coalesce(max_items, 0) <= 0").unionByName(limited)


def remove_items(items: DataFrame, gone: DataFrame) -> DataFrame:
    """Items whose (src, link_url) is not in `gone`; captions do not count."""
    return items.join(gone.select("src", "link_url").distinct(), ["src", "link_url"], "left_anti")


def first_of_run(items: DataFrame) -> DataFrame:
    """One row per `link_key`: where several sources show the same item, the
    first source wins. Merged before the shuffle, so a link shown everywhere is
    no hot key."""
    first = F.min(F.struct("src_ord", "ord", "src", "link_url", "caption")).alias("first")
    return items.groupBy("link_key").agg(first).select("link_key", "first.*")


def item_counts(sets: DataFrame) -> DataFrame:
    """Items per source set, 0 for empty ones; sets hold their items already."""
    return sets.select("src", F.size("items").cast("bigint").alias("n_items"))


def items_in_both(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    return after.join(before.select(*on).distinct(), on, "left_semi")


def latest_snapshots(pages: DataFrame, key: str, order: list[str], id_col: str) -> DataFrame:
    """The newest row of each key. Only keys and ids are aggregated; page texts
    are picked by id afterwards and never sit in aggregation buffers."""
    newest = pages.groupBy(key).agg(F.max(F.struct(*order, id_col)).alias("_m"))
    ids = newest.select(F.col(f"_m.{id_col}").alias(id_col))
    # ids that, measured, are small go to the pages, which then stay where they are
    return pages.join(broadcast_if_small(ids), id_col, "left_semi")
