"""Durations, shift windows and fixed versus daylight-saving offsets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from runlens.functions import clock as C


def value(spark, column):
    return spark.range(1).select(column).first()[0]


EARLY = C.Shift("EARLY", "06:00:00", "14:00:00")
NIGHT = C.Shift("NIGHT", "22:00:00", "06:00:00", -1)


@pytest.mark.parametrize("seconds", [0, 59, 60, 3599, 3600, 86399, 86400, 86461, 172800, 1_000_000])
def test_duration_text_is_that_of_a_time_difference(spark, seconds):
    assert value(spark, C.duration_text(F.lit(seconds).cast("bigint"))) == str(dt.timedelta(seconds=seconds))


def test_duration_of_nothing(spark):
    assert value(spark, C.duration_text(F.lit(None).cast("bigint"))) is None


@pytest.mark.parametrize(
    "shift, as_of, zone, start, end",
    [
        (EARLY, "2024-01-15 17:00:00", "UTC", "2024-01-15 06:00", "2024-01-15 14:00"),
        (NIGHT, "2024-01-15 17:00:00", "UTC", "2024-01-14 22:00", "2024-01-15 06:00"),
        (EARLY, "2024-01-15 17:00:00", "America/Chicago", "2024-01-15 12:00", "2024-01-15 20:00"),
        # 03:00 UTC is still the day before in Chicago.
        (EARLY, "2024-01-15 03:00:00", "America/Chicago", "2024-01-14 12:00", "2024-01-14 20:00"),
        # The clock goes forward at 02:00 on 10 March: the night shift is an hour shorter.
        (NIGHT, "2024-03-10 18:00:00", "America/Chicago", "2024-03-10 04:00", "2024-03-10 11:00"),
    ],
)
def test_shift_bounds(spark, shift, as_of, zone, start, end):
    begin, finish = C.shift_bounds(shift, as_of, zone)
    found = spark.range(1).select(begin, finish).first()
    assert [str(t)[:16] for t in found] == [start, end]


def test_windows_per_row_equal_the_named_bounds(spark):
    moments = ["2024-01-15 17:00:00", "2024-03-10 18:00:00", "2024-11-03 12:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").withColumn("at", F.col("m").cast("timestamp_ntz"))
    for row in C.with_shift_windows(df, F.col("at"), [EARLY, NIGHT], "America/Chicago").collect():
        bounds = spark.range(1).select(*C.shift_bounds({EARLY.name: EARLY, NIGHT.name: NIGHT}[row["shift"]], row["m"], "America/Chicago")).first()
        assert (row["window_start"], row["window_end"]) == tuple(bounds)


def test_minutes_until_uses_a_fixed_offset(spark):
    for day in ("2024-01-15", "2024-07-15"):
        deadline = F.lit(f"{day} 12:30:00").cast("timestamp_ntz")
        assert value(spark, C.minutes_until(deadline, C.moment(f"{day} 17:00:00"))) == 30.0


def test_snapshot_day_follows_the_zone(spark):
    days = {"2024-01-15 05:59:00": 14, "2024-01-15 06:00:00": 15, "2024-07-15 04:59:00": 14, "2024-07-15 05:00:00": 15}
    for at, day in days.items():
        assert value(spark, C.snapshot_day(C.moment(at))).day == day


def test_whole_periods_are_cut_off(spark):
    a, b = C.moment("2024-01-01 00:00:00"), C.moment("2024-01-31 23:59:59")
    assert value(spark, C.whole_days(a, b)) == 30
    assert value(spark, C.whole_minutes(a, C.moment("2024-01-01 00:01:59"))) == 1


def test_results_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = set()
        for zone in ("UTC", "Asia/Kolkata", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            begin, end = C.shift_bounds(NIGHT, "2024-03-10 18:00:00", "America/Chicago")
            row = spark.range(1).select(begin, end).first()
            found.add(tuple(row))
        assert len(found) == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
