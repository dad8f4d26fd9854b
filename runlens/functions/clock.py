"""Clock arithmetic.  Nothing here reads the wall clock: callers pass ``as_of`` in UTC without a zone."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Shift(NamedTuple):
    """A shift of the caller's calendar: wall-clock start and end, and the day its start is from the day of its end."""

    name: str
    start: str
    end: str
    day_offset: int = 0


SLA_OFFSET = "-05:00"
SNAPSHOT_ZONE = "America/Chicago"


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def local_time(at: Column, zone: str) -> Column:
    """A UTC moment on the wall clock of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)


def utc_time(at: Column, zone: str) -> Column:
    """A wall-clock moment of a zone in UTC, with that day's daylight-saving rule."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), at)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def minutes_until(deadline: Column, as_of: Column, offset: str = SLA_OFFSET) -> Column:
    """Minutes, with fraction, from ``as_of`` at a fixed offset to a deadline kept in that offset."""
    return seconds_between(local_time(as_of, offset), deadline) / 60


def whole_minutes(start: Column, end: Column) -> Column:
    return F.floor(seconds_between(start, end) / 60)


def whole_days(start: Column, end: Column) -> Column:
    """Complete 24-hour periods between two moments."""
    return F.floor(seconds_between(start, end) / 86400)


def same_day(at: Column, as_of: Column) -> Column:
    return F.to_date(at) == F.to_date(as_of)


def snapshot_day(at: Column, zone: str = SNAPSHOT_ZONE) -> Column:
    """Calendar day of a UTC moment in the given zone."""
    return F.to_date(local_time(at, zone))


def duration_text(seconds: Column) -> Column:
    """``H:MM:SS``, preceded by ``N day(s), `` from one day on.  Not meant for negative values."""
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    clock = F.format_string(
        "%d:%02d:%02d", F.floor(rest / 3600), F.floor(rest % 3600 / 60), (rest % 60).cast("bigint")
    )
    prefix = F.when(days == 0, "").when(days == 1, "1 day, ").otherwise(F.format_string("%d days, ", days))
    return F.when(seconds.isNotNull(), F.concat(prefix, clock))


def shift_offset(shift: Column, calendar: Sequence[Shift]) -> Column:
    """Day offset of a named shift; NULL for a name that is not in the calendar."""
    result = F.lit(None).cast("int")
    for known in calendar:
        result = F.when(shift == known.name, F.lit(known.day_offset)).otherwise(result)
    return result


def shift_start_date(as_of: Column, day_offset: Column, zone: str = "UTC") -> Column:
    """Date on which the shift that covers ``as_of`` started."""
    return F.date_add(F.to_date(local_time(as_of, zone)), day_offset)


def with_shift_windows(df: DataFrame, as_of: Column, calendar: Sequence[Shift], zone: str = "UTC") -> DataFrame:
    """One row per input row and shift with the shift's UTC bounds around ``as_of``."""
    names = ("shift", "shift_start", "shift_end", "day_offset")
    shifts = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, shift, strict=True)]) for shift in calendar]
    today = F.to_date(local_time(as_of, zone))
    return (
        df.withColumn("_shift", F.explode(F.array(*shifts)))
        .select("*", "_shift.*")
        .withColumn("window_start", utc_time(_at(F.date_add(today, F.col("day_offset")), F.col("shift_start")), zone))
        .withColumn("window_end", utc_time(_at(today, F.col("shift_end")), zone))
        .drop("_shift", "shift_start", "shift_end", "day_offset")
    )


def _at(day: Column, clock: Column) -> Column:
    return F.concat_ws(" ", day.cast("string"), clock).cast("timestamp_ntz")


def shift_bounds(shift: Shift, as_of: str, zone: str = "UTC") -> tuple[Column, Column]:
    """UTC start and end of a shift as constants the scan can be filtered by."""
    today = F.to_date(local_time(moment(as_of), zone))
    start, end = _at(F.date_add(today, shift.day_offset), F.lit(shift.start)), _at(today, F.lit(shift.end))
    return utc_time(start, zone), utc_time(end, zone)
