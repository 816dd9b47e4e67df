"""Time-slot arithmetic on ``TIMESTAMP_NTZ`` columns (UTC wall clock).

Nothing here depends on the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MINUTES = 24 * 60


def minutes_interval(minutes: int) -> Column:
    return F.expr(f"INTERVAL '{int(minutes)}' MINUTE")


def day_start(ts: Column) -> Column:
    """Midnight of the timestamp's own calendar day."""
    return F.to_date(ts).cast("timestamp_ntz")


def slot_start(ts: Column, minutes: int) -> Column:
    """Left edge of the slot holding ``ts``; slots are counted from midnight."""
    if DAY_MINUTES % minutes:
        raise ValueError("the slot length must divide a day")
    if minutes == DAY_MINUTES:
        return day_start(ts)
    if minutes % 60 == 0:
        hour = F.hour(ts) if minutes == 60 else (F.hour(ts) - F.hour(ts) % (minutes // 60)).cast("int")
        return day_start(ts) + F.make_dt_interval(F.lit(0), hour)
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    floored = (minute_of_day - minute_of_day % minutes).cast("int")
    return day_start(ts) + F.make_dt_interval(F.lit(0), F.lit(0), floored)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Whole seconds from ``start`` to ``end``."""
    gap = end - start
    return (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 86400
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * 3600
        + F.extract(F.lit("MINUTE"), gap).cast("bigint") * 60
        + F.floor(F.extract(F.lit("SECOND"), gap)).cast("bigint")
    )


def slot_count(start: Column, end: Column, minutes: int) -> Column:
    """Number of slots in ``[start, end]``, both ends included."""
    return F.floor(elapsed_seconds(start, end) / (minutes * 60)).cast("bigint") + 1


def slots_between(start: Column, end: Column, minutes: int) -> Column:
    return F.sequence(start, end, minutes_interval(minutes))


def to_zone(ts: Column, zone: Column | str) -> Column:
    """UTC wall clock -> wall clock of ``zone``."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return F.convert_timezone(F.lit("UTC"), z, ts)


def from_zone(ts: Column, zone: Column | str) -> Column:
    """Wall clock of ``zone`` -> UTC wall clock."""
    z = zone if isinstance(zone, Column) else F.lit(zone)
    return F.convert_timezone(z, F.lit("UTC"), ts)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
