"""The seen store: keys of sent items with the time of their first sight.

The store is a table `link_key, seen_at`. A key counts for `days` days from its
first sight; it is not renewed while it is alive. A run adds its new keys with
`commit_run`, which keeps the store small by itself (see `operators.levels`).

`append_seen` is the plain form: each run appends a folder of its own,
`run=<n>/seen_date=<day>`; nothing is rewritten, a repeated run replaces its own
folder, and expired days are not scanned. The first `commit_run` on such a store
takes its keys over.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F

from gleaner import schemas
from gleaner.functions.values import DEFAULT_EXPIRY_DAYS
from gleaner.operators import levels
from gleaner.operators.items import first_of_run, with_key
from gleaner.sources.tables import SMALL, measured_bytes


def read_seen(spark: SparkSession, path: str, before_run: int | None = None) -> DataFrame:
    """The store, as it was before a run; empty where there is none yet. Where runs
    were appended, with the columns of that layout."""
    chosen = levels.segments(spark, path, before_run)
    if chosen is not None:
        return levels.read_segments(spark, path, chosen)
    schema = f"{schemas.SEEN}, run BIGINT, seen_date DATE"
    try:
        seen = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return seen if before_run is None else seen.filter(F.col("run") < before_run)


def commit_run(
    new: DataFrame, path: str, run: int, now, days: int = DEFAULT_EXPIRY_DAYS, fanout: int = levels.FANOUT
) -> None:
    """Add the keys of `new`, one row per key and none of them alive, to the store as
    run number `run`, at time `now` or at their own `seen_at`. Expired keys go and
    segments are merged; nothing is deleted before `levels.vacuum`."""
    spark = new.sparkSession
    keys = new.select("link_key", "seen_at" if "seen_at" in new.columns else at(now).alias("seen_at"))
    before = levels.segments(spark, path, run)
    if before is None:
        appended = alive(read_seen(spark, path, run), now, days)
        before = levels.write_segment(appended, path, run, 0)
    levels.commit(keys, path, run, before, expired_by(now, days), fanout)


def append_seen(new: DataFrame, path: str, run: int, now) -> None:
    """Add the keys of `new`, one row per key, to the store."""
    _by_day(new.select("link_key", at(now).alias("seen_at"))).parquet(f"{path}/run={run}")


def _by_day(keys: DataFrame) -> DataFrameWriter:
    """A writer of keys in a folder for each day. Days are dealt out before: a small one
    is one file, a large one is split by size."""
    dated = keys.select("link_key", "seen_at", F.to_date("seen_at").alias("seen_date"))
    return dated.hint("rebalance", "seen_date").write.mode("overwrite").partitionBy("seen_date")


def write_compacted(store: DataFrame, path: str) -> None:
    """Write a store to a new place as its only run, after `cleanup`."""
    _by_day(store).parquet(f"{path}/run=0")


def at(now: datetime | str | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp")


def expired_by(now, days: int = DEFAULT_EXPIRY_DAYS) -> Column:
    """Keys seen then or before have expired."""
    return at(now) - F.make_interval(days=F.lit(days))


def alive(seen: DataFrame, now, days: int = DEFAULT_EXPIRY_DAYS) -> DataFrame:
    """Keys not expired. Plain comparisons with constants, so that they reach
    the scan of the store and leave out the folders of expired days."""
    since = expired_by(now, days)
    live = seen.filter(F.col("seen_at") > since)
    if "seen_date" in seen.columns:
        live = live.filter(F.col("seen_date") >= F.to_date(since))
    return live.select("link_key", "seen_at")


def entries(items: DataFrame, now) -> DataFrame:
    """Store rows of items seen at `now`, one per key."""
    keys = with_key(items) if "link_key" not in items.columns else items
    return keys.select("link_key").distinct().select("link_key", at(now).alias("seen_at"))


def lookup(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Items with the time their key was seen, NULL for new ones."""
    return with_key(items).join(seen.select("link_key", "seen_at"), "link_key", "left")


def relevant(seen: DataFrame, keys: DataFrame, max_bytes: int = SMALL) -> DataFrame:
    """The part of the store that a run can meet.

    The store holds the keys of many runs. When those of this one, measured, are
    small, they are sent to the store and filter its scan; otherwise the store
    comes back as it is, to be shuffled by the join that follows.
    """
    keys = keys.select("link_key").distinct()
    if measured_bytes(keys) > max_bytes:
        return seen
    return seen.join(F.broadcast(keys), "link_key", "left_semi")


def seen_before(
    spark: SparkSession,
    path: str,
    keys: DataFrame,
    now,
    days: int = DEFAULT_EXPIRY_DAYS,
    before_run: int | None = None,
    max_bytes: int = SMALL,
) -> DataFrame:
    """The live keys of a store that a run with these `keys` can meet. When they are
    small, measured, segments whose bitmaps know none of them are not read, and the
    others are filtered by them; otherwise all live keys come back."""
    chosen = levels.segments(spark, path, before_run)
    if chosen is None:
        return relevant(alive(read_seen(spark, path, before_run), now, days), keys, max_bytes)
    keys = keys.select("link_key").distinct()
    small = measured_bytes(keys) <= max_bytes
    if small:
        chosen = levels.meeting(spark, path, chosen, keys)
    live = alive(levels.read_segments(spark, path, chosen), now, days)
    return live.join(F.broadcast(keys), "link_key", "left_semi") if small else live


def new_items(
    items: DataFrame, seen: DataFrame, now, days: int = DEFAULT_EXPIRY_DAYS
) -> DataFrame:
    """Items of a run that are not in the store, one row per key."""
    return first_of_run(with_key(items)).join(alive(seen, now, days), "link_key", "left_anti")


def upsert(seen: DataFrame, new: DataFrame, now, days: int = DEFAULT_EXPIRY_DAYS) -> DataFrame:
    """Store after a run: live old keys and the new ones. `new` comes from
    `new_items`, one row per key and none of them alive, so there is nothing to
    merge and nothing to shuffle."""
    return alive(seen, now, days).unionByName(new.select("link_key", at(now).alias("seen_at")))


def cleanup(seen: DataFrame, now, days: int = DEFAULT_EXPIRY_DAYS) -> DataFrame:
    """Store without expired keys."""
    return alive(seen, now, days)
