"""Traffic figures over events (see sources.model): overviews, series, breakdowns, sessions, goals and properties.

Visitors are distinct sessions. Empty text means "not known" and never forms a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.web import channel
from tidemark.storage import materialize

#: Longest period of a bounded query.
WINDOW_DAYS = 186


def where(events: DataFrame, equals: dict[str, str] | None = None, any_of: dict[str, list[str]] | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Rows that meet all filters: empty values set none, an empty list matches nothing, times are [start, end)."""
    for name, value in (equals or {}).items():
        if value != "":
            events = events.filter(F.col(name) == value)
    for name, values in (any_of or {}).items():
        events = events.filter(F.col(name).isin(values) if values else F.lit(False))
    if start_ms is not None:
        events = events.filter(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        events = events.filter(F.col("ts_ms") < end_ms)
    return events


def sessions(events: DataFrame) -> DataFrame:
    """One row per session: first and last time, counts, entry and exit page, dimensions of the first event.

    A bounce is a session with at most one event of any type; the duration is last minus first, in seconds.
    """
    at = F.struct("ts_ms", "event_id")
    page = F.when(F.col("event_type") == "pageview", at)
    return events.groupBy("session_id").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("events"), F.count(page).alias("pageviews"),
        F.min_by("pathname", page).alias("entry_page"), F.max_by("pathname", page).alias("exit_page"), F.min_by("browser", at).alias("browser"), F.min_by("country", at).alias("country"),
        (F.count("*") <= 1).alias("is_bounce"), ((F.max("ts_ms") - F.min("ts_ms")) / 1000).alias("duration_s"),
    )


def overview(events: DataFrame) -> DataFrame:
    """One row: pageviews, visitors and visits over pageviews; bounce share and mean duration over sessions."""
    page = F.col("event_type") == "pageview"
    counts = events.agg(F.count_if(page).alias("pageviews"), F.count_distinct(F.when(page, F.col("session_id"))).alias("visitors"), F.count_distinct(F.when(page, F.col("visit_id"))).alias("visits"))
    quality = sessions(events).agg(F.count("*").alias("sessions"), (100 * F.avg(F.col("is_bounce").cast("double"))).alias("bounce_pct"), F.avg("duration_s").alias("mean_duration_s"))
    return counts.join(F.broadcast(quality))  # one row each


def compared(events: DataFrame, start_ms: int, end_ms: int, shift_ms: int) -> DataFrame:
    """The overview's counts of [start, end) and of the same span shift_ms earlier, as columns with prefix previous_."""
    page = F.col("event_type") == "pageview"

    def counts(at: int, prefix: str) -> list[Column]:
        inside = page & (F.col("ts_ms") >= at) & (F.col("ts_ms") < at + end_ms - start_ms)
        return [F.count_if(inside).alias(f"{prefix}pageviews"), F.count_distinct(F.when(inside, F.col("session_id"))).alias(f"{prefix}visitors")]

    return where(events, start_ms=start_ms - shift_ms, end_ms=end_ms).agg(*counts(start_ms, ""), *counts(start_ms - shift_ms, "previous_"))


def realtime(events: DataFrame, now_ms: int, minutes: int = 5) -> DataFrame:
    return where(events, start_ms=now_ms - minutes * 60_000).agg(F.count_distinct("session_id").alias("visitors"))


def bucket(ms: str, width: int) -> Column:
    return F.expr(f"({ms} div {width}) * {width}")


def timeseries(events: DataFrame, width_ms: int) -> DataFrame:
    """Pageviews and visitors per bucket of fixed width, aligned to the epoch (a month is 30 days)."""
    return where(events, {"event_type": "pageview"}).groupBy(bucket("ts_ms", width_ms).alias("bucket_ms")).agg(F.count("*").alias("pageviews"), F.count_distinct("session_id").alias("visitors"))


def top_pages(events: DataFrame, n: int = 10) -> DataFrame:
    pages = where(events, {"event_type": "pageview"}).groupBy("pathname").agg(F.count("*").alias("pageviews"), F.count_distinct("session_id").alias("visitors"))
    return pages.orderBy(F.desc("pageviews"), "pathname").limit(n)


def breakdown(events: DataFrame, dimension: str | Column) -> DataFrame:
    """Visitors and events by a dimension, without its empty value."""
    value = F.col(dimension) if isinstance(dimension, str) else dimension
    known = events.withColumn("value_", value).filter("value_ <> ''")
    return known.groupBy(F.col("value_").alias("name")).agg(F.count_distinct("session_id").alias("visitors"), F.count("*").alias("events"))


def channels(events: DataFrame) -> DataFrame:
    """Visitors by acquisition channel; a session counts in each channel it came by. Ways of coming are classified once."""
    ways = events.select("session_id", "utm_source", "utm_medium", "referrer").distinct()
    classified = ways.select("session_id", channel(F.col("utm_source"), F.col("utm_medium"), F.col("referrer")).alias("channel"))
    return classified.groupBy("channel").agg(F.count_distinct("session_id").alias("visitors"))


def session_pages(events: DataFrame, which: str) -> DataFrame:
    """Sessions by entry_page or exit_page."""
    return sessions(events).filter(F.col(which) != "").groupBy(F.col(which).alias("page")).agg(F.count("*").alias("sessions"))


def custom_events(events: DataFrame) -> DataFrame:
    return events.filter("event_type <> 'pageview'").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("visitors"))


def properties(events: DataFrame) -> DataFrame:
    """Events and visitors by key and value of the property object."""
    pairs = events.select("session_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return pairs.groupBy("key", "value").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("visitors"))


def property_keys(events: DataFrame) -> DataFrame:
    return events.select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("events"))


def property_values(events: DataFrame, key: str, n: int = 20) -> DataFrame:
    value = F.get_json_object("props", f"$.{key}")
    return events.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "value").limit(n)


def goal(events: DataFrame, event_type: str, scale: int = 100) -> DataFrame:
    """One row: converting sessions and events, share of all sessions in percent, value in minor units."""
    hit = F.col("event_type") == event_type
    return events.agg(
        F.count_distinct(F.when(hit, F.col("session_id"))).alias("conversions"), F.count_if(hit).alias("events"),
        (100 * F.count_distinct(F.when(hit, F.col("session_id"))) / F.count_distinct("session_id")).alias("rate_pct"),
        F.sum(F.when(hit, F.round(F.col("value") * scale)).cast("long")).alias("value_minor"),
    )


def heatmap(clicks: DataFrame) -> DataFrame:
    """Clicks (x, y, viewport_width) by cells of 10 x 10 pixels and 100 pixels of viewport; positions are cell centres."""
    cell = [(F.floor(F.col(c) / w) * w + w // 2).cast("long").alias(c) for c, w in (("x", 10), ("y", 10))]
    return clicks.groupBy(*cell, (F.floor(F.col("viewport_width") / 100) * 100).cast("long").alias("viewport_width")).agg(F.count("*").alias("clicks"))


def board(events: DataFrame, site: str) -> DataFrame:
    """Per site: pageviews, visitors over pageviews, errors and last activity."""
    page = F.col("event_type") == "pageview"
    return events.groupBy(F.col(site).alias("site")).agg(
        F.count_if(page).alias("pageviews"), F.count_distinct(F.when(page, F.col("session_id"))).alias("visitors"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("ts_ms").alias("last_ms")
    )


def newest(events: DataFrame, n: int = 20, before: tuple[int, int] | None = None) -> DataFrame:
    """The newest events, or the newest before a cursor of (time, id)."""
    if before:
        events = events.filter(F.struct("ts_ms", "event_id") < F.struct(F.lit(before[0]).alias("ts_ms"), F.lit(before[1]).alias("event_id")))
    return events.orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(n)


def persons(events: DataFrame) -> DataFrame:
    """Known persons: first and last time, events, sessions, newest country."""
    return events.filter("distinct_id <> ''").groupBy("distinct_id").agg(
        F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.max_by("country", F.struct("ts_ms", "event_id")).alias("country")
    )


def session_events(events: DataFrame, session_id: str) -> DataFrame:
    """The events of one session in order, with the time since its first."""
    mine = events.filter(F.col("session_id") == session_id)
    return mine.withColumn("since_ms", F.col("ts_ms") - F.min("ts_ms").over(Window.partitionBy("session_id"))).orderBy("ts_ms", "event_id")


def sessions_with_errors(events: DataFrame) -> DataFrame:
    """(session_id, events, errors, first_error_ms) of sessions, recorded ones say, in which an error occurred."""
    bad = F.col("event_type") == "error"
    return events.groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(bad).alias("errors"), F.min(F.when(bad, F.col("ts_ms"))).alias("first_error_ms")).filter("errors > 0")


def page_goal(events: DataFrame, path: str, value_minor: int = 0) -> DataFrame:
    """(conversions, events, rate_pct, value_minor) of views of exactly this path; each is worth value_minor."""
    hit = (F.col("event_type") == "pageview") & (F.col("pathname") == path)
    return events.agg(
        F.count_distinct(F.when(hit, F.col("session_id"))).alias("conversions"), F.count_if(hit).alias("events"),
        F.try_divide(100.0 * F.count_distinct(F.when(hit, F.col("session_id"))), F.count_distinct("session_id")).alias("rate_pct"), (value_minor * F.count_if(hit)).alias("value_minor"),
    )


def admitted(start_ms: int, end_ms: int) -> None:
    """Refuses periods that are empty, reversed or longer than WINDOW_DAYS days."""
    if end_ms <= start_ms:
        raise ValueError("a period begins before it ends")
    if end_ms - start_ms > WINDOW_DAYS * 86_400_000:
        raise ValueError(f"periods are limited to {WINDOW_DAYS} days")


def bounded(events: DataFrame, start_ms: int, end_ms: int, n: int) -> DataFrame:
    """All rows of [start, end) in order of time and id where they are at most n; more are refused when rows are read.

    The bound is met by counting n + 1 rows, which need no sort; a result is never cut silently.
    """
    admitted(start_ms, end_ms)
    inside = events.filter((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    over = inside.limit(n + 1).agg(F.count("*").alias("rows_"))
    fits = F.assert_true(F.col("rows_") <= n, F.lit(f"the period has more than {n} rows"))
    checked = inside.join(F.broadcast(over)).filter(fits.isNull())  # one row
    return checked.drop("rows_").orderBy("ts_ms", "event_id")


def canonical(aliases: DataFrame, rounds: int = 40) -> DataFrame:
    """(alias, canonical): each alias of (alias, target) followed to its end, at most 2 ** rounds links away.

    Each round is written and doubles the links followed; it ends when all are at an end, or, where there are cycles,
    when the links followed are as many as aliases. The members of a cycle and what leads into it end at its smallest
    member. Of several targets of an alias the smallest counts.
    """
    single = aliases.filter("alias <> target").groupBy("alias").agg(F.min("target").alias("canonical"))
    current = materialize(single.withColumn("least", F.least("alias", "canonical")), "aliases")
    ends = current.select(F.col("alias").alias("end_"), F.col("canonical").alias("to_"), F.col("least").alias("least_"))
    for _ in range(min(rounds, current.count().bit_length() + 1)):
        met = current.join(ends, F.col("canonical") == F.col("end_"), "left")
        if not met.filter("end_ is not null").limit(1).count():
            break
        current = materialize(met.select("alias", F.coalesce("to_", "canonical").alias("canonical"), F.least("least", "least_").alias("least")), "aliases")
        ends = current.select(F.col("alias").alias("end_"), F.col("canonical").alias("to_"), F.col("least").alias("least_"))
    return current.join(ends, F.col("canonical") == F.col("end_"), "left").select("alias", F.coalesce("least_", "canonical").alias("canonical"))


def folded(people: DataFrame, aliases: DataFrame) -> DataFrame:
    """persons() by canonical person; session counts are summed, as aliases have sessions of their own."""
    named = people.join(aliases, F.col("distinct_id") == F.col("alias"), "left").withColumn("person", F.coalesce("canonical", "distinct_id"))
    return named.groupBy("person").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.sum("events").alias("events"), F.sum("sessions").alias("sessions"))


def ranked(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group in descending order of a column, ties by the others."""
    rest = [c for c in df.columns if c not in (by, order)]
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order), *rest))).filter(F.col("rank") <= n)
