"""Next runs of cron schedules, durations of steps and windows, and minor units of currencies, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_S, DAY_MS = 86_400, 86_400_000
#: What the short names of schedules stand for.
NAMED = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
WEEKDAYS = "sun mon tue wed thu fri sat".split()
#: Least and most of seconds, minutes, hours, days, months, weekdays (7 is Sunday too).
BOUNDS = ((0, 59), (0, 59), (0, 23), (1, 31), (1, 12), (0, 7))
PIECE = re.compile(r"(?:[*?]|(?P<a>\d+)(?P<range>-(?P<b>\d+))?)(?:/(?P<step>\d+))?")
#: Days looked at: the longest wait, for a 29 February across a century that is no leap year.
NEAR_DAYS, ALL_DAYS = 62, 2922
#: Nanoseconds of the units of a duration.
UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "μs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}
DURATION_PART = r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|μs|ms|s|m|h)"
#: Decimal places of currencies that do not have two (ISO 4217).
PLACES = {
    "BIF": 0, "CLP": 0, "DJF": 0, "GNF": 0, "ISK": 0, "JPY": 0, "KMF": 0, "KRW": 0, "PYG": 0, "RWF": 0, "UGX": 0, "UYI": 0, "VND": 0, "VUV": 0, "XAF": 0, "XOF": 0, "XPF": 0,
    "BHD": 3, "IQD": 3, "JOD": 3, "KWD": 3, "LYD": 3, "OMR": 3, "TND": 3, "CLF": 4, "UYW": 4,
}


def _numbers(field: str, least: int, most: int) -> list[int]:
    """The numbers that a field of a schedule allows; ValueError for a malformed one."""
    found: set[int] = set()
    for piece in field.split(","):
        m = PIECE.fullmatch(piece)
        if m is None:
            raise ValueError(f"malformed field {field!r}")
        step = int(m["step"] or 1)
        low = least if m["a"] is None else int(m["a"])
        high = int(m["b"]) if m["range"] else most if m["a"] is None or m["step"] else low
        if not (least <= low <= high <= most and 0 < step <= most - least + 1):
            raise ValueError(f"field {field!r} is outside {least} to {most}")
        found.update(range(low, high + 1, step))
    return sorted(found)


def duration_ns(text: Column) -> Column:
    """Nanoseconds of a duration such as 1h30m or 1.5s, null where it is none."""
    parts = F.regexp_extract_all(text, F.lit(DURATION_PART), F.lit(0))
    factor = F.create_map(*[F.lit(x) for unit in UNITS.items() for x in unit])

    def part(x: Column) -> Column:
        return F.floor(F.regexp_extract(x, r"^[0-9.]+", 0).try_cast("decimal(28,9)") * F.try_element_at(factor, F.regexp_extract(x, r"[^0-9.]+$", 0)).cast("decimal(14,0)")).try_cast("long")

    total = F.aggregate(parts, F.lit(0).cast("long"), lambda sum_, x: F.try_add(sum_, part(x)))
    return F.when(text.rlike(f"^[+]?({DURATION_PART})+$"), total)


def step_ms(text: Column) -> Column:
    """Milliseconds of a metric step: a minute if empty, 1d, or a duration of whole milliseconds up to a day, else null."""
    ns = duration_ns(text)
    given = F.when((ns >= 1_000_000) & (ns % 1_000_000 == 0) & (ns <= DAY_MS * 1_000_000), (ns / 1_000_000).cast("long"))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(60_000).cast("long")).when(text == "1d", F.lit(DAY_MS).cast("long")).otherwise(given)


def window_ms(text: Column) -> Column:
    """Milliseconds of a cohort window, a number of days, hours or minutes: 30 days if empty, null if invalid or too long."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    unit = F.substring(t, -1, 1)
    width = F.when(unit == "d", DAY_MS).when(unit == "h", 3_600_000).otherwise(60_000).cast("long")
    n = F.regexp_extract(t, "^[+]?([0-9]+)[dhm]$", 1).try_cast("long")
    most = F.lit((2**63 - 1) // 1_000_000)
    return F.when(t == "", F.lit(30 * DAY_MS)).when((n > 0) & (n <= F.floor(most / width)), n * width)


def minor_unit_scale(currency: Column) -> Column:
    """Minor units of one unit of a currency: 100 for those without an entry, null included."""
    scales = F.create_map(*[F.lit(x) for code, places in PLACES.items() for x in (code, 10**places)])
    return F.coalesce(F.try_element_at(scales, F.upper(currency)), F.lit(100)).cast("long")


def next_run_ms(schedule: str, after_ms: Column) -> Column:
    """The first run of a schedule strictly after a time (ms, UTC), null if none comes in eight years.

    Five fields, or six with seconds first; names of months and weekdays; @daily and the like; @every with a duration.
    Where days and weekdays are both restricted either may match. ValueError for what is no schedule.
    """
    text = schedule.strip().lower()
    if text.startswith("@every "):
        every = duration_ns(F.lit(text.removeprefix("@every ").strip()))
        return F.when(every > 0, (after_ms + every / 1_000_000).cast("long"))
    fields = NAMED.get(text, text).split()
    fields = ["0", *fields] if len(fields) == 5 else fields
    if len(fields) != 6:
        raise ValueError(f"{schedule!r} has neither five nor six fields")
    for at, names, first in ((4, MONTHS, 1), (5, WEEKDAYS, 0)):
        for k, name in enumerate(names):
            fields[at] = fields[at].replace(name, str(k + first))
    allowed = [_numbers(field, *bounds) for field, bounds in zip(fields, BOUNDS, strict=True)]
    seconds, minutes, hours, days, months, weekdays = allowed
    either = not fields[3].startswith(("*", "?")) and not fields[5].startswith(("*", "?"))

    now = F.floor(after_ms / 1000).cast("long")
    day = F.floor(now / DAY_S).cast("int")
    hour, minute, second = F.floor(now / 3600) % 24, F.floor(now / 60) % 60, now % 60
    hour, minute, second = (F.when(x < 0, x + n).otherwise(x) for x, n in ((hour, 24), (minute, 60), (second, 60)))

    def above(values: list[int], x: Column) -> Column:
        return F.array_min(F.filter(F.array(*map(F.lit, values)), lambda v: v > x))

    same_minute = F.when(hour.isin(hours) & minute.isin(minutes), hour * 3600 + minute * 60 + above(seconds, second))
    same_hour = F.when(hour.isin(hours), hour * 3600 + above(minutes, minute) * 60 + seconds[0])
    later = F.coalesce(same_minute, same_hour, above(hours, hour) * 3600 + minutes[0] * 60 + seconds[0])

    def runs_on(d: Column) -> Column:
        date = F.date_from_unix_date(d)
        of_month, of_week = F.dayofmonth(date).isin(days), (F.dayofweek(date) - 1).isin([w % 7 for w in weekdays])
        return F.month(date).isin(months) & (of_month | of_week if either else of_month & of_week) & ((d > day) | later.isNotNull())

    def first_day(span: int) -> Column:
        return F.get(F.filter(F.sequence(day, day + span), runs_on), F.lit(0))

    on = F.coalesce(first_day(NEAR_DAYS), first_day(ALL_DAYS))
    at = F.when(on == day, later).otherwise(hours[0] * 3600 + minutes[0] * 60 + seconds[0])
    return ((on.cast("long") * DAY_S + at) * 1000).cast("long")


def deadline_ms(schedule: str, last_ms: Column, grace_s: int = 300) -> Column:
    """When a monitor that ran last at last_ms is late; without a schedule the grace alone counts."""
    run = next_run_ms(schedule, last_ms) if schedule.strip() else last_ms
    return run + (grace_s if grace_s > 0 else 300) * 1000
