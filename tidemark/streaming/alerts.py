"""Alert rules over a stream of evaluations: operators.alerts.incidents with its state kept between micro-batches.

Needs spark.sql.streaming.stateStore.providerClass set to Spark's RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.alerts import OPENED, RECOVERED, REPEAT, state

RESULT = "rule string, ts_ms long, value double, samples long, from_state string, state string, incident_ms long, notice string"
_RESULT = Row(*(x.split()[0] for x in RESULT.split(", ")))


class RuleStates(StatefulProcessor):
    """State, open incident, last notice and last evaluation of each rule; a timer notices that evaluations stop."""

    def __init__(self, silence_ms: int | None = None):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", "state string, incident_ms long, notified_ms long, last_ms long, due_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now, incident, notified, last, due = self.rule.get() if self.rule.exists() else ("", None, None, None, None)
        for r in sorted(rows, key=lambda r: r["ts_ms"]):
            at = r["ts_ms"]
            if last is not None and at <= last:  # a replayed evaluation
                continue
            if due is not None and at > due:
                yield _RESULT(key[0], due, None, 0, now, "unavailable", incident, "")
                now = "unavailable"
            before, now, notice = now, r["state"], ""
            if now == "firing":
                if incident is None:
                    incident, notified, notice = at, at, OPENED
                elif 0 < r["cooldown_ms"] <= at - notified:
                    notified, notice = at, REPEAT
            named = incident
            if now == "healthy" and incident is not None:
                incident, notified, notice = None, None, RECOVERED
            yield _RESULT(key[0], at, r["value"], r["samples"], before, now, named, notice)
            last, due = at, None if self.silence_ms is None else at + self.silence_ms
        self._expect(due)
        self.rule.update((now, incident, notified, last, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, incident, notified, last, due = self.rule.get()
        if due is not None and expiredTimerInfo.getExpiryTimeInMs() == due:
            yield _RESULT(key[0], due, None, 0, now, "unavailable", incident, "")
            self.rule.update(("unavailable", incident, notified, last, None))

    def _expect(self, due: int | None) -> None:
        for old in list(self.handle.listTimers()):
            if old != due:
                self.handle.deleteTimer(old)
        if due is not None:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def incidents(evaluations: DataFrame, silence_ms: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Stream of evaluations (rule, ts_ms, value, samples, operator, threshold, min_samples, cooldown_min) with states.

    A rule's evaluations are taken in order of time; what is not later than the last one taken, a replay say, is dropped.
    An unavailable row for silence comes when the watermark has passed it.
    """
    shown = evaluations.select("rule", "ts_ms", F.timestamp_millis("ts_ms").alias("ts"), F.col("value").cast("double").alias("value"), F.col("samples").cast("long").alias("samples"), state().alias("state"), (F.coalesce("cooldown_min", F.lit(0)) * 60_000).cast("long").alias("cooldown_ms"))
    return shown.withWatermark("ts", late).groupBy("rule").transformWithState(RuleStates(silence_ms), RESULT, "Append", "EventTime")
