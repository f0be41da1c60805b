"""Traffic from the table that fits: raw events, hourly or daily rollups, or session summaries, with what is covered.

Rollups answer pageviews; uniques do not add up over their rows and come from raw events or, where these have expired,
from session summaries, one row each. Filters on columns that a table lacks keep a question on raw events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.traffic import admitted, where
from tidemark.sources.model import DAY_MS

EVENTS, HOURLY, DAILY, SESSIONS = "events", "stats_hourly", "stats_daily", "sessions"
#: Days that raw events and session summaries are kept; 0 keeps them for ever.
RAW_DAYS, SESSION_DAYS = 30, 90


@dataclass(frozen=True)
class Coverage:
    """Where uniques come from, whether nothing is missing, since when they are covered, and what to say if not so."""

    source: str
    exact: bool
    covered_from_ms: int
    covered_days: int = 0
    note: str = ""


@dataclass(frozen=True)
class Tiers:
    """The tables of one site as retention has left them. events: ts_ms, session_id; hourly, daily: bucket_ms, event_type,
    events; sessions: session_id, first_ms."""

    events: DataFrame
    hourly: DataFrame
    daily: DataFrame
    sessions: DataFrame
    raw_days: int = RAW_DAYS
    session_days: int = SESSION_DAYS

    def pageview_table(self, start_ms: int, end_ms: int, filters: dict[str, str]) -> str:
        """Raw events up to a day, hourly rollups up to seven, daily ones beyond; raw where the rollup lacks a column."""
        days = (end_ms - start_ms) / DAY_MS
        name = EVENTS if days <= 1 else HOURLY if days <= 7 else DAILY
        return EVENTS if name != EVENTS and outside(self._table(name), filters) else name

    def _table(self, name: str) -> DataFrame:
        return {EVENTS: self.events, HOURLY: self.hourly, DAILY: self.daily, SESSIONS: self.sessions}[name]

    def pageviews(self, start_ms: int, end_ms: int, filters: dict[str, str] | None = None) -> DataFrame:
        """One row: pageviews, and table, the one that they are read from. Rollups count whole buckets that begin in the period."""
        admitted(start_ms, end_ms)
        filters = filters or {}
        name = self.pageview_table(start_ms, end_ms, filters)
        df = self._table(name)
        timed = df if name == EVENTS else df.withColumnRenamed("bucket_ms", "ts_ms")
        mine = where(timed, filters | {"event_type": "pageview"}, start_ms=start_ms, end_ms=end_ms)
        count = F.count("*") if name == EVENTS else F.coalesce(F.sum("events"), F.lit(0))
        return mine.agg(count.alias("pageviews")).withColumn("table", F.lit(name))

    def unique_source(self, start_ms: int, now_ms: int, filters: dict[str, str]) -> tuple[str, int | None, int]:
        """(table, since when it can answer, if anything bounds it, and that bound in days); the period's begin decides."""
        raw = cutoff(self.raw_days, now_ms)
        if raw is None or start_ms >= raw:
            return EVENTS, None, 0
        if outside(self.sessions, filters):
            return EVENTS, raw, self.raw_days
        kept = cutoff(self.session_days, now_ms)
        return (SESSIONS, None, 0) if kept is None or start_ms >= kept else (SESSIONS, kept, self.session_days)

    def earliest(self) -> int | None:
        """The begin of the oldest bucket of daily rollups, which outlive all else."""
        return self.daily.agg(F.min("bucket_ms")).first()[0]

    def coverage(self, start_ms: int, now_ms: int, filters: dict[str, str] | None = None) -> Coverage:
        """What the uniques of a period cover. Retention has taken something only where there was something older."""
        source, bound, days = self.unique_source(start_ms, now_ms, filters or {})
        if bound is None:
            return Coverage(source, True, start_ms)
        first = self.earliest()
        if first is None or first >= bound:
            return Coverage(source, True, max(start_ms, first) if first is not None else start_ms)
        why = "the active filter can only be applied to raw events, which retention keeps for that long" if source == EVENTS else "per-visitor data older than that has been removed by retention. Pageviews still cover the whole range"
        return Coverage(source, False, bound, days, f"Visitor counts cover the last {days} days of this range, not all of it — {why}.")

    def visitors(self, start_ms: int, end_ms: int, now_ms: int, filters: dict[str, str] | None = None) -> DataFrame:
        """One row: visitors, source, exact, covered_from_ms and note. A session counts in the period that it began in
        where summaries answer, and in each that it has a pageview in where raw events do."""
        admitted(start_ms, end_ms)
        filters = filters or {}
        found = self.coverage(start_ms, now_ms, filters)
        if found.source == SESSIONS:
            mine = where(self.sessions.withColumn("ts_ms", F.col("first_ms")), filters, start_ms=start_ms, end_ms=end_ms)
            counted = mine.agg(F.count("*").alias("visitors"))
        else:
            counted = where(self.events, filters | {"event_type": "pageview"}, start_ms=start_ms, end_ms=end_ms).agg(F.count_distinct("session_id").alias("visitors"))
        return counted.select("visitors", F.lit(found.source).alias("source"), F.lit(found.exact).alias("exact"), F.lit(found.covered_from_ms).alias("covered_from_ms"), F.lit(found.note).alias("note"))


def cutoff(days: int, now_ms: int) -> int | None:
    return now_ms - days * DAY_MS if days > 0 else None


def outside(df: DataFrame, filters: dict[str, str]) -> bool:
    """A filter that is set names a column that the table lacks."""
    return any(value != "" and name not in df.columns for name, value in filters.items())


def subset(df: DataFrame, filters: dict[str, str]) -> dict[str, str]:
    """The filters whose columns the table has."""
    return {name: value for name, value in filters.items() if name in df.columns}
