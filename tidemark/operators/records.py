"""Records that change over time: issue states, replays, surveys, model calls, digests, properties, audit chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.digests import hmac_sha256
from tidemark.functions.web import host, stable_bucket
from tidemark.operators.lookups import in_ranges
from tidemark.sources.model import DAY_MS

NUMBER = r"^-?[0-9]+(\.[0-9]+)?$"


def issue_states(errors: DataFrame, decisions: DataFrame, issue: str) -> DataFrame:
    """(issue, events, last_ms, state) from errors (issue, ts_ms) and decisions (issue, ts_ms, status).

    Without a decision an issue is new at its first event and open after it. The newest decision holds, except that an
    event after 'resolved' makes the issue regressed.
    """
    seen = errors.groupBy(issue).agg(F.count("*").alias("events"), F.max("ts_ms").alias("last_ms"))
    held = decisions.groupBy(issue).agg(F.max_by("status", F.struct("ts_ms", "status")).alias("status"), F.max("ts_ms").alias("decided_ms"))
    state = (
        F.when(F.col("status").isNull(), F.when(F.col("events") == 1, "new").otherwise("open"))
        .when((F.col("status") == "resolved") & (F.col("last_ms") > F.col("decided_ms")), "regressed")
        .otherwise(F.col("status"))
    )
    return seen.join(held, issue, "left").select(issue, "events", "last_ms", state.alias("state"))


def replays(batches: DataFrame) -> DataFrame:
    """One row per replay of its batches (replay_id, start_ms, end_ms, navigations, has_error)."""
    return batches.groupBy("replay_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"), F.sum("navigations").alias("pages"), F.bool_or("has_error").alias("has_error")
    )


def survey_shown(url: Column, device: Column, referrer: Column, person: Column, *, key: str, equals: str | None = None, prefix: str | None = None, contains: str | None = None, on: list[str] | None = None, from_host: str | None = None, percent: int = 100) -> Column:
    """Whether a survey's rules all hold; a rule that is not given holds, a missing value meets none."""
    rules = [stable_bucket(F.lit(key), person) - 1 < percent]
    rules += [url == equals] if equals is not None else []
    rules += [F.startswith(url, F.lit(prefix))] if prefix is not None else []
    rules += [F.contains(url, F.lit(contains))] if contains is not None else []
    rules += [device.isin(*on)] if on is not None else []
    rules += [host(referrer) == from_host] if from_host is not None else []
    out = rules[0]
    for r in rules[1:]:
        out = out & r
    return F.coalesce(out, F.lit(False))


def survey_stats(responses: DataFrame, shown: str, answered: str) -> DataFrame:
    """Per survey: people it was shown to and who answered, answers, and the share of people."""
    def people(kind: str) -> Column:
        return F.count_distinct(F.when(F.col("event_type") == kind, F.col("distinct_id")))

    counts = responses.groupBy("survey").agg(people(shown).alias("shown"), people(answered).alias("answered"), F.count_if(F.col("event_type") == answered).alias("answers"))
    return counts.withColumn("rate_pct", F.coalesce(100 * F.col("answered") / F.nullif("shown", F.lit(0).cast("long")), F.lit(0.0)))


def model_usage(calls: DataFrame) -> DataFrame:
    """Calls, tokens and cost by model and provenance; tokens and cost are texts, and what is no number counts as 0."""
    def number(c: str) -> Column:
        return F.when(F.col(c).rlike(NUMBER), F.col(c).try_cast("double")).otherwise(0.0)

    return calls.groupBy("model", "provenance").agg(F.count("*").alias("calls"), F.sum(number("tokens_in")).alias("tokens_in"), F.sum(number("tokens_out")).alias("tokens_out"), F.sum(number("cost")).alias("cost"))


def digest(events: DataFrame, end_ms: int) -> DataFrame:
    """Page views, visitors and errors of the last day and the last seven days before end_ms, in one pass."""
    ts = F.col("ts_ms")

    def since(days: int, *more: Column) -> Column:
        held = ts >= end_ms - days * DAY_MS
        for m in more:
            held = held & m
        return held

    page, error = F.col("event_type") == "pageview", F.col("event_type") == "error"
    figures = [f for d in (1, 7) for f in (
        F.count_if(since(d, page)).alias(f"pageviews_{d}d"), F.count_distinct(F.when(since(d), F.col("session_id"))).alias(f"visitors_{d}d"), F.count_if(since(d, error)).alias(f"errors_{d}d"),
    )]
    return events.filter((ts >= end_ms - 7 * DAY_MS) & (ts < end_ms)).agg(*figures)


def properties(changes: DataFrame) -> DataFrame:
    """(person, key, value) that hold after all changes (person, key, value, removed, ts_ms, id)."""
    last = changes.groupBy("person", "key").agg(F.max_by(F.struct("value", "removed"), F.struct("ts_ms", "id")).alias("last"))
    return last.filter(~F.col("last.removed")).select("person", "key", "last.value")


def outside_windows(points: DataFrame, windows: DataFrame, key: str, at: str, width: int) -> DataFrame:
    """points (unique key) in no maintenance window; of windows (window_id, version, lo, hi) the newest version holds."""
    current = windows.groupBy("window_id").agg(F.max_by(F.struct("lo", "hi"), "version").alias("w")).select("w.lo", "w.hi")
    return points.join(in_ranges(points.select(key, at), current, at, width).select(key), key, "left_anti")


def chain_breaks(entries: DataFrame, key: bytes, log: str = "log") -> DataFrame:
    """Entries (log, seq, payload, previous, digest) that do not continue their log's chain.

    A digest is the HMAC of the previous digest and the payload. Each entry is held against its predecessor alone, so a
    log is sorted, not walked; the first entry follows an empty digest.
    """
    order = Window.partitionBy(log).orderBy("seq")
    before = F.coalesce(F.lag("digest").over(order), F.lit(""))
    right = hmac_sha256(F.concat_ws("\n", F.col("previous"), F.col("payload")), key)
    return entries.withColumn("before", before).filter(~(F.col("previous").eqNullSafe(F.col("before")) & F.col("digest").eqNullSafe(right))).drop("before")
