"""Streaming queries, run over all that is available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.operators.items import explode_items, with_key
from gleaner.plans.source_sets import source_sets
from gleaner.queries import sql
from gleaner.queries.registry import query
from gleaner.queries.schedule import DUE, schedule_moments
from gleaner.sources.tables import new_dir
from gleaner.streaming.common import state_store, write_all
from gleaner.streaming.digest import run_stream
from gleaner.streaming.seen import new_items_stream as first_seen
from gleaner.streaming.ticks import due_stream


BATCHES = 3


def _stream(spark, sf, name):
    """A table as a stream, be it one file or a folder of files: as a pattern, since a plain
    path has to be a folder."""
    batch = inputs.table(spark, sf, name)
    return spark.readStream.schema(batch.schema).parquet(f"{sf}/{name}.parque[t]")


def _landed(spark, sf, name, order):
    """A table as a stream of about `BATCHES` micro-batches, landed in the order of a
    column. Each part is written by all tasks; a stream takes files in the order of landing."""
    batch = inputs.table(spark, sf, name)
    place = F.col(order).cast("timestamp").cast("double") if order == "ts" else F.col(order).cast("double")
    low, high = batch.agg(F.min(place), F.max(place)).first()
    path = new_dir(spark, name)
    if low is None:
        batch.limit(0).write.parquet(path)
    else:
        part = F.least(F.floor((place - low) / (max(high - low, 1) / BATCHES)), F.lit(BATCHES - 1))
        for n in range(BATCHES):
            batch.filter(part == n).write.mode("append").parquet(path)
    files = len(spark.read.schema(batch.schema).parquet(path).inputFiles())
    return spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", max(1, -(-files // BATCHES))).parquet(path)


@query(
    "due_newsletters_stream",
    f"{DUE} SELECT f.date, f.day, f.hour, m.handle FROM fired f "
    "JOIN moments m ON f.day = m.day AND f.hour = m.hour",
)
def due_newsletters_stream(spark, sf):
    ticks = _landed(spark, sf, "events", "ts").select(F.col("ts").cast("timestamp").alias("ts"))
    due = due_stream(ticks, schedule_moments(spark, sf))
    out = new_dir(spark, "due")
    write_all(due, f"{out}/table", f"{out}/checkpoint")
    return spark.read.schema(due.schema).parquet(f"{out}/table")


@query(
    "new_items_stream",
    f"WITH {sql.SET_ITEMS} SELECT link_key, min(caption) AS caption FROM set_items GROUP BY link_key",
)
def new_items_stream(spark, sf):
    pages = _landed(spark, sf, "pages", "page_id").select(
        F.col("page_id").cast("string").alias("src"),
        F.col("page_id").cast("string").alias("name"),
        "url",
        F.lit(0).alias("max_items"),
        F.lit(0).alias("min_element_words"),
        F.col("page_id").alias("src_ord"),
        F.lit(200).alias("status"),
        "html",
        F.lit(True).alias("fetched"),
    )
    items = with_key(explode_items(source_sets(pages)))
    fetched_at = F.timestamp_seconds(F.lit(1700000000) + F.col("src_ord"))
    new = first_seen(items.withColumn("fetched_at", fetched_at), inputs.EXPIRY_DAYS)
    out = new_dir(spark, "new-items")
    with state_store(spark):
        write_all(new, f"{out}/table", f"{out}/checkpoint")
    return spark.read.schema(new.schema).parquet(f"{out}/table").select("link_key", "caption")


@query("newsletter_stream", f"{sql.RUN} SELECT DISTINCT link_key, caption, link_url FROM good_items")
def newsletter_stream(spark, sf):
    """Items of the digests of a page stream that starts with an empty store."""
    fetched = _stream(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("src"),
        inputs.by_turns("page_id", inputs.STATUS).alias("status"),
        "html",
    )
    out = new_dir(spark, "digests")
    run_stream(
        inputs.sources(spark, sf), fetched, f"{out}/runs", f"{out}/checkpoint",
        lambda batch_id: inputs.NOW, inputs.EXPIRY_DAYS,
    )
    items = spark.read.parquet(f"{out}/runs/*/items")
    return items.select("link_key", "caption", "link_url")
