"""Weekly schedules such as "MWF 12"."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gleaner.functions import values as v


def _day_bit(day: Column) -> Column:
    """Bit of a day marker, Monday = 1; NULL for unknown markers."""
    place = F.array_position(F.array(*[F.lit(d) for d in v.DAYS]), day)
    return F.when(place > 0, F.pow(F.lit(2), place - 1).cast("int"))


def parse(text: Column) -> Column:
    """STRUCT<weekdays, hour, error> of a schedule text. The hour range is not
    checked, and an empty day part gives a schedule that never fires."""
    parts = F.split(F.coalesce(text, F.lit("")), " ")
    days = F.regexp_extract_all(F.get(parts, F.lit(0)), F.lit(f"({v.DAY_MARKER})"), F.lit(1))
    bits = F.transform(days, _day_bit)
    hour = F.get(parts, F.lit(1))
    error = (
        F.when(F.size(parts) != 2, F.lit(v.ERR_SCHEDULE_PARTS))
        .when(F.exists(bits, lambda b: b.isNull()), F.lit(v.ERR_SCHEDULE_DAY))
        .when(
            ~hour.rlike(r"^[+-]?[0-9]+\z") | hour.try_cast("int").isNull(),
            F.lit(v.ERR_SCHEDULE_HOUR),
        )
    )
    bitmap = F.aggregate(bits, F.lit(0), lambda acc, b: acc.bitwiseOR(b))
    return F.struct(
        F.when(error.isNull(), bitmap).alias("weekdays"),
        F.when(error.isNull(), hour.try_cast("int")).alias("hour"),
        error.alias("error"),
    )


def day_numbers(weekdays: Column) -> Column:
    """Days in a bitmap, Monday = 0 first."""
    return F.filter(
        F.sequence(F.lit(0), F.lit(6)),
        lambda d: F.getbit(weekdays, d) == 1,
    )


def moment(ts: Column) -> Column:
    """STRUCT<date, day, hour> of a time stamp in the session time zone."""
    return F.struct(
        F.to_date(ts).alias("date"), F.weekday(ts).alias("day"), F.hour(ts).alias("hour")
    )
