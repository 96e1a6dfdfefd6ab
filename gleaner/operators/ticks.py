"""Schedules and ticks: which digests are due."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from gleaner.functions import schedules


def moments(parsed: DataFrame) -> DataFrame:
    """Schedules (`handle, weekdays, hour`) as rows `handle, day, hour`, Monday = 0."""
    return parsed.select(
        "handle", F.explode(schedules.day_numbers(F.col("weekdays"))).alias("day"), "hour"
    )


def parse_schedules(texts: DataFrame) -> DataFrame:
    """`handle, schedule` -> `handle, weekdays, hour, error`."""
    return texts.withColumn("_p", schedules.parse(F.col("schedule"))).select("handle", "_p.*")


def with_moment(ticks: DataFrame, ts: str = "ts") -> DataFrame:
    return ticks.withColumn("_m", schedules.moment(F.col(ts))).select(*ticks.columns, "_m.*")


def due_ticks(ticks: DataFrame, ts: str = "ts") -> DataFrame:
    """First tick of each (date, hour): `date, day, hour, ts`.

    In time order "not the same hour as the tick before" is "first of its hour",
    so this is an aggregate with map-side merging, not a window over all ticks.
    """
    return with_moment(ticks, ts).groupBy("date", "day", "hour").agg(F.min(ts).alias(ts))


def due_ticks_by_arrival(
    ticks: DataFrame, arrival: str, ts: str = "ts", block: int = 1_000_000
) -> DataFrame:
    """Ticks that differ in (date, hour) from the tick that arrived before them;
    time may run backwards, and then an hour fires again.

    The previous tick is found inside blocks of `block` arrival numbers. Blocks
    are compared in levels, each level's blocks inside blocks of `_WIDTH` of
    them, so that no window holds more than `block` or `_WIDTH` rows.
    """
    blocks = with_moment(ticks, ts).withColumn("_block", F.expr(f"`{arrival}` DIV {block}"))
    moment = F.struct("date", "hour")
    last = blocks.groupBy("_block").agg(F.max(F.struct(arrival, "date", "hour")).alias("_l"))
    carried = _last_before(last).select(
        "_block", F.struct("_before._l.date", "_before._l.hour").alias("_carried")
    ).filter("_carried.date is not null")
    inside = Window.partitionBy("_block").orderBy(arrival)
    before = blocks.withColumn("_before", F.lag(moment).over(inside)).join(carried, "_block", "left")
    changed = ~moment.eqNullSafe(F.coalesce("_before", "_carried"))
    return before.filter(changed).select(*ticks.columns, "date", "day", "hour")


_WIDTH, _LEVELS = 1 << 15, 3  # blocks of blocks: 2 ** 45 blocks at most


def _last_before(last: DataFrame, level: int = 1) -> DataFrame:
    """`last` (`_block, _l`) with `_before`: `_l` of the block before each."""
    inside = Window.partitionBy("_above").orderBy("_block")
    rows = last.withColumn("_above", F.expr(f"_block DIV {_WIDTH}"))
    rows = rows.withColumn("_before", F.lag(F.struct("_l")).over(inside))
    if level == _LEVELS:
        return rows
    above = rows.groupBy(F.col("_above").alias("_block")).agg(F.max("_l").alias("_l"))
    carried = _last_before(above, level + 1).select(F.col("_block").alias("_above"), F.col("_before").alias("_first"))
    return rows.join(carried, "_above", "left").withColumn("_before", F.coalesce("_before", "_first"))


def due(ticks: DataFrame, moments: DataFrame) -> DataFrame:
    """Digest handles due at each fired tick. No broadcast hint: the number of
    schedules is not bounded, adaptive execution decides by size."""
    return ticks.join(moments, ["day", "hour"])
