"""Schedules against a plain search second by second, and durations with known values."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import schedules


def ms(*parts):
    return int(dt.datetime(*parts, tzinfo=dt.UTC).timestamp() * 1000)


def run(spark, schedule, *after):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(after)], "i int, a long")
    return [r["run"] for r in rows.select("i", schedules.next_run_ms(schedule, F.col("a")).alias("run")).orderBy("i").collect()]


def test_known_runs(spark):
    assert run(spark, "*/15 * * * *", ms(2024, 1, 1, 0, 15), ms(2024, 1, 1, 23, 59)) == [ms(2024, 1, 1, 0, 30), ms(2024, 1, 2)]
    assert run(spark, "0 0 29 2 *", ms(2096, 2, 29), ms(2023, 3, 1)) == [ms(2104, 2, 29), ms(2024, 2, 29)]
    assert run(spark, "0 9 13 * fri", ms(2024, 9, 12, 10)) == [ms(2024, 9, 13, 9)]  # either day counts
    assert run(spark, "0 9 */2 * 5", ms(2024, 9, 1, 10)) == [ms(2024, 9, 13, 9)]  # both must: a day starting with a star
    assert run(spark, "30 0 0 1 jan 7", ms(2024, 1, 1)) == [ms(2024, 1, 1, 0, 0, 30)]
    assert run(spark, "@Daily", ms(2024, 2, 28, 1)) == [ms(2024, 2, 29)]
    assert run(spark, "@every 90s", ms(2024, 1, 1)) == [ms(2024, 1, 1, 0, 1, 30)]
    assert run(spark, "0 0 30 2 *", ms(2024, 1, 1)) == [None]
    assert run(spark, "* * * * *", None, -61_500) == [None, -60_000]


@pytest.mark.parametrize("schedule", ["", "* * * *", "60 * * * *", "5-3 * * * *", "*/0 * * * *", "1- * * * *", "x * * * *", "* * 0 * *"])
def test_no_schedule(schedule):
    with pytest.raises(ValueError):
        schedules.next_run_ms(schedule, F.lit(0))


@pytest.mark.parametrize("schedule", ["5,35 3-5 * * *", "0 0 1 */3 *", "*/20 1/7 * * 1-3", "10 */25 6 * * *"])
def test_against_a_search(spark, schedule):
    rng = random.Random(schedule)
    fields = schedule.split()
    fields = ["0", *fields] if len(fields) == 5 else fields
    allowed = [set(schedules._numbers(f, *b)) for f, b in zip(fields, schedules.BOUNDS, strict=True)]

    def plain(after):
        t = dt.datetime.fromtimestamp(after // 1000, dt.UTC)
        while True:
            t += dt.timedelta(seconds=1)
            values = (t.second, t.minute, t.hour, t.day, t.month, t.isoweekday() % 7)
            if values[0] not in allowed[0]:
                continue
            if values[4] not in allowed[4] or values[3] not in allowed[3] or values[5] not in allowed[5]:
                t = t.replace(hour=23, minute=59, second=59)
            elif all(v in a for v, a in zip(values, allowed, strict=True)):
                return int(t.timestamp()) * 1000

    after = [ms(2024, 1, 1) + rng.randrange(200 * schedules.DAY_MS) for _ in range(12)]
    assert run(spark, schedule, *after) == [plain(a) for a in after]


def test_durations(spark):
    steps = {None: 60_000, "": 60_000, "1m": 60_000, "1d": 86_400_000, "24h": 86_400_000, "24h1ms": None, "1.5s": 1500, "1h30m": 5_400_000, ".5m": 30_000, "0s": None, "-5s": None, "5": None, "2d": None, "1500us": None, "2000us": 2}
    windows = {None: 2_592_000_000, " 7D ": 604_800_000, "24h": 86_400_000, "5m": 300_000, "0d": None, "-1d": None, "d": None, "5": None, "106751d": 106_751 * 86_400_000, "106752d": None, "99999999999999999999d": None}
    for function, cases in ((schedules.step_ms, steps), (schedules.window_ms, windows)):
        rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", function(F.col("t")).alias("v")).collect()
        assert {r["t"]: r["v"] for r in rows} == cases


def test_minor_units(spark):
    rows = spark.createDataFrame([("usd",), ("JPY",), ("kwd",), ("CLF",), ("",), (None,)], "c string")
    assert [r[0] for r in rows.select(schedules.minor_unit_scale(F.col("c"))).collect()] == [100, 1, 1000, 10_000, 100, 100]
