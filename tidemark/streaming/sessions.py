"""Session summaries kept up to date by a stream: operators.traffic.sessions without the events of earlier micro-batches.

Needs spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a session is reduced to; pairs of (time, id) tell which event is first and last, and which pageview.
_STATE = (
    "first_ms long, first_id long, browser string, country string, last_ms long, last_id long, events long, pageviews long, entry_ms long, entry_id long, entry_page string, exit_ms long, exit_id long, exit_page string"
)
_KINDS = {"first_ms": T.LongType(), "last_ms": T.LongType(), "events": T.LongType(), "pageviews": T.LongType(), "is_bounce": T.BooleanType(), "duration_s": T.DoubleType()}
SCHEMA = T.StructType([T.StructField(c, _KINDS.get(c, T.StringType())) for c in "session_id first_ms last_ms events pageviews entry_page exit_page browser country is_bounce duration_s".split()])
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_RESULT = Row(*SCHEMA.names)


class Summary(StatefulProcessor):
    """The summary of each session, until ttl_ms of event time after its last event."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("summary", _STATE)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.kept.update(tuple(initialState[c] for c in _NAMES))
        self.handle.registerTimer(initialState["last_ms"] + self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = dict(zip(_NAMES, self.kept.get(), strict=True)) if self.kept.exists() else dict.fromkeys(_NAMES) | {"events": 0, "pageviews": 0}
        for r in rows:
            at, view = (r["ts_ms"], r["event_id"]), r["event_type"] == "pageview"
            s["events"] += 1
            s["pageviews"] += view
            if s["first_ms"] is None or at < (s["first_ms"], s["first_id"]):
                s |= {"first_ms": at[0], "first_id": at[1], "browser": r["browser"], "country": r["country"]}
            if s["last_ms"] is None or at > (s["last_ms"], s["last_id"]):
                s |= {"last_ms": at[0], "last_id": at[1]}
            if view and (s["entry_ms"] is None or at < (s["entry_ms"], s["entry_id"])):
                s |= {"entry_ms": at[0], "entry_id": at[1], "entry_page": r["pathname"]}
            if view and (s["exit_ms"] is None or at > (s["exit_ms"], s["exit_id"])):
                s |= {"exit_ms": at[0], "exit_id": at[1], "exit_page": r["pathname"]}
        self.kept.update(tuple(s[c] for c in _NAMES))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(s["last_ms"] + self.ttl_ms)
        yield _RESULT(key[0], *(s[c] for c in ("first_ms", "last_ms", "events", "pageviews", "entry_page", "exit_page", "browser", "country")), s["events"] <= 1, (s["last_ms"] - s["first_ms"]) / 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.kept.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.kept.get()[_NAMES.index("last_ms")] + self.ttl_ms:
            self.kept.clear()
        yield from ()

    def close(self) -> None:
        pass


def prior(events: DataFrame) -> DataFrame:
    """What summaries() continues from: the state of the sessions of events that the stream does not bring."""
    at = F.struct("ts_ms", "event_id")
    page = F.when(F.col("event_type") == "pageview", at)
    of = events.groupBy("session_id").agg(
        F.min(at).alias("first"), F.min_by("browser", at).alias("browser"), F.min_by("country", at).alias("country"), F.max(at).alias("last"), F.count("*").alias("events"), F.count(page).alias("pageviews"),
        F.min(page).alias("entry"), F.min_by("pathname", page).alias("entry_page"), F.max(page).alias("exit"), F.max_by("pathname", page).alias("exit_page"),
    )
    pairs = {f"{n}_{c}": F.col(n)[k] for n in ("first", "last", "entry", "exit") for c, k in (("ms", "ts_ms"), ("id", "event_id"))}
    return of.withColumns(pairs).select("session_id", *_NAMES)


def summaries(events: DataFrame, ttl_ms: int = 86_400_000, late: str = "2 hours", before: DataFrame | None = None) -> DataFrame:
    """Stream of events (session_id, event_id, ts_ms, event_type, pathname, browser, country) as changed summaries.

    Each micro-batch gives the sessions it touches, with their figures since they began: write them to a KeyedTable with
    SCHEMA, key session_id and version events. before is prior() of earlier events. What comes more than ttl_ms after a
    session's last event begins it anew; its summary replaces the old one once it has more events.
    """
    shown = events.select("session_id", "event_id", "ts_ms", F.timestamp_millis("ts_ms").alias("ts"), "event_type", "pathname", "browser", "country")
    begin = before.groupBy("session_id") if before is not None else None
    return shown.withWatermark("ts", late).groupBy("session_id").transformWithState(Summary(ttl_ms), SCHEMA, "Update", "EventTime", begin)
