"""Schedules and ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import inputs
from gleaner.functions import values as v
from gleaner.operators import ticks as op
from gleaner.queries import sql
from gleaner.queries.registry import query

_WEEKDAYS = [1 + 4 + 16, 2 + 8, 32 + 64, 1, 1, 4 + 1 + 2, None, None, None, 127]
_HOURS = [12, 9, 20, 8, 15, 13, None, None, None, 0]
_ERRORS = [None, None, None, None, None, None, v.ERR_SCHEDULE_DAY, v.ERR_SCHEDULE_HOUR,
           v.ERR_SCHEDULE_PARTS, None]

_PARSED = f"""
parsed AS (
  SELECT 'digest-' || c_custkey AS handle, {sql.by_turns('c_custkey', _WEEKDAYS)} AS weekdays,
         {sql.by_turns('c_custkey', _HOURS)} AS hour, {sql.by_turns('c_custkey', _ERRORS)} AS error
  FROM customer)"""
_MOMENTS = f"""{_PARSED},
moments AS (
  SELECT handle, CAST(d AS INTEGER) AS day, hour
  FROM parsed, (SELECT unnest(range(0, 7)) AS d) WHERE (weekdays >> CAST(d AS INTEGER)) & 1 = 1)"""
_TICKS = """
fired AS (
  SELECT CAST(ts AS DATE) AS date, CAST(isodow(ts) - 1 AS INTEGER) AS day,
         CAST(hour(ts) AS INTEGER) AS hour, ts FROM (
    SELECT ts, lag(date_trunc('hour', ts)) OVER (ORDER BY ts) AS before FROM events)
  WHERE before IS DISTINCT FROM date_trunc('hour', ts))"""


@query("schedule_parse", f"WITH {_PARSED} SELECT * FROM parsed")
def schedule_parse(spark, sf):
    return op.parse_schedules(inputs.schedules(spark, sf))


@query("schedule_moments", f"WITH {_MOMENTS} SELECT * FROM moments")
def schedule_moments(spark, sf):
    return op.moments(op.parse_schedules(inputs.schedules(spark, sf)))


@query(
    "moment_handles",
    f"WITH {_MOMENTS} SELECT day, hour, count(*) AS n_handles, min(handle) AS first_handle, "
    "max(handle) AS last_handle FROM moments GROUP BY day, hour",
)
def moment_handles(spark, sf):
    """How many digests each moment has. The handles of a moment stay rows of
    `schedule_moments`: a list per moment would put a third of all schedules
    into one row."""
    return (
        schedule_moments(spark, sf)
        .groupBy("day", "hour")
        .agg(
            F.count("*").alias("n_handles"),
            F.min("handle").alias("first_handle"),
            F.max("handle").alias("last_handle"),
        )
    )


@query("due_ticks", f"WITH {_TICKS} SELECT date, day, hour, ts FROM fired")
def due_ticks(spark, sf):
    return op.due_ticks(inputs.ticks(spark, sf))


@query(
    "due_ticks_by_arrival",
    """WITH arrived AS (
         SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 2 HOUR ELSE ts END AS due
         FROM events),
       m AS (SELECT event_id, due AS ts, date_trunc('hour', due) AS h FROM arrived)
       SELECT event_id, ts, CAST(ts AS DATE) AS date, CAST(isodow(ts) - 1 AS INTEGER) AS day,
              CAST(hour(ts) AS INTEGER) AS hour
       FROM (SELECT *, lag(h) OVER (ORDER BY event_id) AS before FROM m)
       WHERE before IS DISTINCT FROM h""",
)
def due_ticks_by_arrival(spark, sf):
    late = F.when(F.col("event_id") % 3 == 0, F.col("ts") - F.expr("INTERVAL 2 HOURS"))
    ticks = inputs.ticks(spark, sf).withColumn("ts", F.coalesce(late, F.col("ts")))
    return op.due_ticks_by_arrival(ticks, "event_id", block=1000)


DUE = f"WITH {_MOMENTS}, {_TICKS}"


@query(
    "due_newsletters",
    f"{DUE} SELECT f.ts, f.date, f.day, f.hour, m.handle FROM fired f "
    "JOIN moments m ON f.day = m.day AND f.hour = m.hour",
)
def due_newsletters(spark, sf):
    return op.due(op.due_ticks(inputs.ticks(spark, sf)), schedule_moments(spark, sf))
