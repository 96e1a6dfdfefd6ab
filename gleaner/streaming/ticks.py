"""Tick stream: fire each due digest once per hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gleaner.operators.ticks import with_moment


def due_stream(ticks: DataFrame, moments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Streaming `date, day, hour, handle`, once per (date, hour) and schedule.

    State is one row per open hour, dropped after `delay`. Ticks are taken to
    come in order within `delay`. The fired hours of a batch, 24 a day at most,
    are sent to the schedules, which are not shuffled whatever their number.
    """
    marked = with_moment(ticks).select("ts", "date", "day", "hour")
    fired = marked.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["date", "hour"])
    return moments.join(F.broadcast(fired), ["day", "hour"]).select("date", "day", "hour", "handle")
