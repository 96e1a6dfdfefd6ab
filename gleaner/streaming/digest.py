"""Page stream -> one digest per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.functions.values import DEFAULT_EXPIRY_DAYS
from gleaner.plans.digest import run_digest


def run_stream(
    sources: DataFrame,
    fetched: DataFrame,
    out: str,
    checkpoint: str,
    now: Callable[[int], object],
    days: int = DEFAULT_EXPIRY_DAYS,
) -> StreamingQuery:
    """Run over everything that has landed, one digest per micro-batch, below
    `out/<batch number>`; the store is `out/seen`.

    Each batch reads the keys of the batches before it and writes its own, so a
    batch that is repeated after a failure gives the same result. Sources
    without a page in a batch are not part of its digest.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        run_digest(
            sources, batch, now(batch_id), f"{out}/{batch_id}", f"{out}/seen", batch_id, days,
            missing=False,
        )

    query = (
        fetched.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_when_due(
    due: DataFrame,
    sources: DataFrame,
    read_pages: Callable[[], DataFrame],
    started,
    out: str,
    checkpoint: str,
    days: int = DEFAULT_EXPIRY_DAYS,
) -> StreamingQuery:
    """The first digest at once, at time `started`, then one for each due hour of
    one schedule (a stream of `date, hour`, see `due_stream`), below `out/<run>`.

    The number of a run is its hour since 1970, so that a repeated batch
    replaces its own digests; the store is `out/seen`.
    """

    def run(number: int, now, first: int) -> None:
        run_digest(
            sources, read_pages(), now, f"{out}/{number}", f"{out}/seen", number, days, keep_from=first
        )

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        hours = F.unix_timestamp(F.col("date").cast("timestamp")) / 3600 + F.col("hour")
        # at most 24 a day
        due_hours = batch.select(hours.cast("bigint").alias("n")).distinct().orderBy("n").collect()
        for (number,) in due_hours:
            # the batch is repeated from its first hour, should it fail
            run(number, F.timestamp_seconds(F.lit(number * 3600)), due_hours[0].n)

    run(0, started, 0)
    query = (
        due.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
