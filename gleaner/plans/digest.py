"""One run: sets of all sources -> new items -> digest body and store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gleaner.functions.values import DEFAULT_EXPIRY_DAYS
from gleaner.operators import levels, sections as body, store
from gleaner.operators.items import explode_items, first_of_run, with_key
from gleaner.plans.source_sets import source_pages, source_sets


def run_items(
    sets: DataFrame, seen: DataFrame | None, now, days: int = DEFAULT_EXPIRY_DAYS
) -> DataFrame:
    """Items to send. Without a store (one-off or test runs) nothing is looked
    up, and an item that two sources show is sent for both."""
    items = explode_items(sets)
    return with_key(items) if seen is None else store.new_items(items, seen, now, days)


def digest(sets: DataFrame, items: DataFrame, html: bool = True) -> DataFrame:
    """Body fragments of a run, see `operators.sections`."""
    return body.render(body.sections(sets, items), items, html)


@dataclass
class Run:
    """Where the outputs of a run were written."""

    sets: str
    items: str
    html: str
    text: str


def run_digest(
    sources: DataFrame,
    fetched: DataFrame,
    now,
    out: str,
    seen_path: str | None = None,
    run: int = 0,
    days: int = DEFAULT_EXPIRY_DAYS,
    missing: bool = True,
    keep_from: int | None = None,
) -> Run:
    """Run once: write the sets, the new items and both bodies below `out`, and
    add the new keys to the store at `seen_path` as run number `run`, which merges
    its segments, drops expired keys and deletes what runs from `keep_from` (this one,
    if not given) on don't need to be repeated. All folders are shared by the executors. Without a store (one-off and test runs) nothing
    is looked up or remembered. Of several pages of a source the newest counts;
    of equally new ones any. `missing`: sources without a page are told about.

    Pages are parsed once: sets and items are written tables, and what follows
    reads those, so a lost executor never costs a second parse.
    """
    spark = sources.sparkSession
    done = Run(f"{out}/sets", f"{out}/items", f"{out}/html", f"{out}/text")
    sets = source_sets(source_pages(sources, fetched, missing))
    sets.dropDuplicates(["src"]).write.mode("overwrite").parquet(done.sets)
    sets = spark.read.parquet(done.sets)
    seen = None
    if seen_path is not None:
        keys = with_key(explode_items(sets))
        seen = store.seen_before(spark, seen_path, keys, now, days, before_run=run)
    run_items(sets, seen, now, days).write.mode("overwrite").parquet(done.items)
    items = spark.read.parquet(done.items)
    body.write_body(digest(sets, items, html=True), done.html)
    body.write_body(digest(sets, items, html=False), done.text)
    if seen_path is not None:
        store.commit_run(items.select("link_key"), seen_path, run, now, days)
        levels.vacuum(spark, seen_path, run if keep_from is None else keep_from)
    return done
