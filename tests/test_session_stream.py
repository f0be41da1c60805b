"""Session summaries of a stream against those of all events at once, over restarts, late rows and earlier summaries."""

import random

from tests.test_ledger import rocks  # noqa: F401
from tidemark.operators import traffic
from tidemark.streaming import jobs, sessions
from tidemark.streaming.keyed import KeyedTable

SCHEMA = "session_id string, event_id long, ts_ms long, event_type string, pathname string, browser string, country string"
MINUTE = 60_000


def some_events(n):
    rng = random.Random(5)
    rows = [(f"s{rng.randrange(14)}", i, (1000 + i // 2 + rng.randrange(6)) * MINUTE, rng.choice(["pageview", "pageview", "click"]), f"/{rng.randrange(9)}", rng.choice(["Edge", "Chrome", None]), rng.choice(["DE", "FR"])) for i in range(n)]
    return [("alone", n, 1000 * MINUTE, "click", "/x", "Edge", "DE"), *rows]


def run(spark, path, parts, before=None):
    table = KeyedTable(f"{path}/table", ("session_id",), "events", sessions.SCHEMA, 3)
    for part in parts:
        for i in range(0, len(part), 40):
            spark.createDataFrame(part[i : i + 40], SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        out = sessions.summaries(stream, 60 * MINUTE, "15 minutes", before)
        query = out.writeStream.foreachBatch(jobs.upsert(table)).outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination(150)
        assert query.exception() is None
    return {r["session_id"]: tuple(r) for r in table.read(spark).collect()}


def expected(spark, rows):
    found = traffic.sessions(spark.createDataFrame(rows, SCHEMA)).select(*sessions.SCHEMA.names)
    return {r["session_id"]: tuple(r) for r in found.collect()}


def test_stream_equals_batch(spark, tmp_path, rocks):  # noqa: F811
    rows = some_events(200)
    assert run(spark, str(tmp_path), (rows[:80], rows[80:])) == expected(spark, rows)


def test_earlier_summaries_go_on(spark, tmp_path, rocks):  # noqa: F811
    rows = some_events(160)
    before = sessions.prior(spark.createDataFrame(rows[:80], SCHEMA))
    found, whole = run(spark, str(tmp_path), (rows[80:],), before), expected(spark, rows)
    touched = {r[0] for r in rows[80:]}
    assert {k: v for k, v in found.items() if k in touched} == {k: v for k, v in whole.items() if k in touched}
