"""Lists and panels over what is stored: replays by filters, groups, tracked links, panel figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.model import DAY_MS, HOUR_MS

#: An error may arrive this long after the replay's window.
ERROR_SLACK_MS = HOUR_MS
#: Widths of an error panel's buckets; a month has thirty days.
PANEL_STEPS = {"hour": HOUR_MS, "day": DAY_MS, "week": 7 * DAY_MS, "month": 30 * DAY_MS}


def _within(start_ms: int, end_ms: int, at: str = "ts_ms") -> Column:
    return (F.col(at) >= start_ms) & (F.col(at) < end_ms)


def filtered_replays(replays: DataFrame, errors: DataFrame, start_ms: int, end_ms: int, *, person: str = "", least_ms: int = 0, url: str = "", with_errors: bool = False, n: int = 20, skip: int = 0) -> DataFrame:
    """The newest n replays (one row each) that start in [start, end) and meet all filters that are set, ties by id.

    url is a part of the address in any case. A replay has errors if it says so, or if an error (session_id, replay_id,
    ts_ms) of the window or up to ERROR_SLACK_MS later names its session or itself; empty ids name nothing.
    """
    found = replays.filter(_within(start_ms, end_ms, "start_ms"))
    if person:
        found = found.filter(F.col("distinct_id") == person)
    if least_ms:
        found = found.filter(F.col("duration_ms") >= least_ms)
    if url:
        found = found.filter(F.contains(F.lower("url"), F.lower(F.lit(url))))
    if with_errors:
        near = errors.filter(_within(start_ms, end_ms + ERROR_SLACK_MS))
        for name in ("session_id", "replay_id"):
            named = near.filter(F.col(name) != "").select(name).distinct().withColumn(f"{name}_named", F.lit(True))
            found = found.join(named, name, "left")
        says = F.coalesce("has_error", F.lit(False)) | F.col("session_id_named").isNotNull() | F.col("replay_id_named").isNotNull()
        found = found.filter(says).drop("session_id_named", "replay_id_named")
    return found.orderBy(F.desc("start_ms"), "replay_id").offset(skip).limit(n)


def group_metrics(groups: DataFrame, members: DataFrame, events: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """groups (group_id) with their member sessions and those sessions' events in [start, end).

    Events are counted per session before they meet the groups, so a session of many groups is read once.
    """
    known = members.filter(F.col("session_id") != "").select("group_id", "session_id").distinct()
    seen = events.filter(_within(start_ms, end_ms)).groupBy("session_id").agg(F.count("*").alias("n"))
    counted = known.join(seen, "session_id", "left").groupBy("group_id").agg(F.count("*").alias("members"), F.sum("n").alias("events"))
    zero = F.lit(0).cast("long")
    return groups.join(counted, "group_id", "left").withColumns({c: F.coalesce(c, zero) for c in ("members", "events")})


def link_clicks(links: DataFrame, clicks: DataFrame) -> DataFrame:
    """links (link_id) with the number of their clicks; a link without any has 0."""
    counted = clicks.groupBy("link_id").agg(F.count("*").alias("clicks"))
    return links.join(counted, "link_id", "left").withColumn("clicks", F.coalesce("clicks", F.lit(0).cast("long")))


def panel(events: DataFrame, errors: DataFrame, kind: str, start_ms: int, end_ms: int) -> DataFrame:
    """One value of [start, end): 'pageviews', 'visitors' (sessions of any event) or 'errors'; other kinds raise."""
    figures = {"pageviews": (events, F.count_if(F.col("event_type") == "pageview")), "visitors": (events, F.count_distinct("session_id")), "errors": (errors, F.count("*"))}
    if kind not in figures:
        raise ValueError(f"unsupported panel {kind!r}")
    rows, figure = figures[kind]
    return rows.filter(_within(start_ms, end_ms)).agg(figure.alias("value"))


def error_panel(errors: DataFrame, start_ms: int, end_ms: int, interval: str = "hour") -> DataFrame:
    """Errors of [start, end) by bucket; an interval that is not known counts as an hour."""
    step = PANEL_STEPS.get(interval, HOUR_MS)
    bucket = F.col("ts_ms") - F.col("ts_ms") % step
    return errors.filter(_within(start_ms, end_ms)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("errors"))
