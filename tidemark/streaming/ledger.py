"""Exactly-once admission: what a producer sends again is told from what it sends under a used name with other content.

Rows have site, producer, event_id, ts_ms and payload. The ledger keeps the digest of the payload that was applied under
(site, producer, event_id); the same digest again is repeated, another one a conflict, neither is applied. Rows without
an event_id are applied each time they come. The stream form needs spark.sql.streaming.stateStore.providerClass set to
Spark's RocksDB provider: what it knows lies in the state store, and a micro-batch reads the state of its own keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEY = ("site", "producer", "event_id")
APPLIED, REPEATED, CONFLICT = "applied", "repeated", "conflict"


def digest(payload: str = "payload") -> Column:
    """SHA-256 of a payload; null payloads are empty."""
    return F.sha2(F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary"), 256)


def _named() -> Column:
    return F.coalesce(F.col("event_id").cast("string"), F.lit("")) != ""


def outcomes(rows: DataFrame) -> DataFrame:
    """rows with digest and outcome. Of the rows of a key the first by (ts_ms, digest) is applied, one of equal ones."""
    keyed = rows.withColumn("digest", digest())
    order = Window.partitionBy(*KEY).orderBy("ts_ms", "digest")
    first = F.first("digest").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    outcome = F.when(F.row_number().over(order) == 1, APPLIED).when(F.col("digest") == first, REPEATED).otherwise(CONFLICT)
    legacy = keyed.filter(~_named()).withColumn("outcome", F.lit(APPLIED))
    return keyed.filter(_named()).withColumn("outcome", outcome).unionByName(legacy)


class Admission(StatefulProcessor):
    """The applied digest of each key and when it was applied, kept for retention_ms of event time."""

    def __init__(self, names: list[str], retention_ms: int | None):
        self.names, self.retention_ms = names, retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.applied = handle.getValueState("applied", "digest string, ts_ms long")
        self.out = Row(*self.names, "outcome")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known, since = self.applied.get() if self.applied.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r["ts_ms"], r["digest"])):
            old = known is None or self.retention_ms is not None and r["ts_ms"] >= since + self.retention_ms
            if old:
                known, since = r["digest"], r["ts_ms"]
                self.applied.update((known, since))
                self._expect(since)
            yield self.out(*(r[c] for c in self.names), APPLIED if old else REPEATED if r["digest"] == known else CONFLICT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.applied.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.applied.get()[1] + self.retention_ms:
            self.applied.clear()
        yield from ()

    def _expect(self, since: int) -> None:
        if self.retention_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(since + self.retention_ms)

    def close(self) -> None:
        pass


def admitted(rows: DataFrame, retention_ms: int | None = None, late: str = "1 hour") -> DataFrame:
    """Stream of rows that have an event_id, with digest and outcome; retention_ms after it was applied a key is new.

    Rows without an event_id need no state: union them from the same source, filtered by `event_id is null`.
    """
    keyed = rows.filter(_named()).withColumn("digest", digest()).withColumn("ts", F.timestamp_millis("ts_ms"))
    shown = [f for f in keyed.schema.fields if f.name != "ts"]
    result = T.StructType([*shown, T.StructField("outcome", T.StringType())])
    return keyed.withWatermark("ts", late).groupBy(*KEY).transformWithState(Admission([f.name for f in shown], retention_ms), result, "Append", "EventTime")
