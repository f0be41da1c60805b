"""Admission outcomes and keyed tables: repeated, overlapping and changed batches, failures half-way, restarts."""

import random

import pytest
from pyspark.sql import types as T

from tidemark.streaming import jobs, ledger
from tidemark.streaming.keyed import KeyedTable

ROWS = "site string, producer string, event_id string, ts_ms long, payload string"


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def plain_outcomes(rows, retention=None):
    """[(row, outcome)] of rows in order of time."""
    known, out = {}, []
    for r in sorted(rows, key=lambda r: r[3]):
        key = r[:3]
        if not r[2]:
            out.append((r, "applied"))
        elif key not in known or retention is not None and r[3] >= known[key][1] + retention:
            known[key] = r[4], r[3]
            out.append((r, "applied"))
        else:
            out.append((r, "repeated" if known[key][0] == r[4] else "conflict"))
    return sorted(out, key=repr)


def some_rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("st"), rng.choice("pq"), rng.choice([None, "", *"abcdefgh"]), 1_000_000 + i, rng.choice(["x", "x", "x", "y"])) for i in range(n)]


def test_outcomes(spark):
    rows = some_rows(120, 1)
    found = ledger.outcomes(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(((tuple(r)[:5], r["outcome"]) for r in found), key=repr) == plain_outcomes(rows)
    same = ledger.outcomes(spark.createDataFrame([("s", "p", "a", 1, "x")] * 3 + [("s", "p", "a", 1, None)], ROWS)).collect()
    assert sorted(r["outcome"] for r in same) in (["applied", "conflict", "conflict", "conflict"], ["applied", "conflict", "repeated", "repeated"])
    assert ledger.outcomes(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("retention", [None, 40])
def test_stream_over_restarts(spark, tmp_path, rocks, retention):
    rows = some_rows(100, 3)
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for part in (rows[:30], rows[30:35], rows[35:]):
        for i in range(0, len(part), 10):
            spark.createDataFrame(part[i : i + 10], ROWS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
        query = ledger.admitted(stream, retention).writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(150)
        assert query.exception() is None
    found = sorted(((tuple(r[c] for c in ("site", "producer", "event_id", "ts_ms", "payload")), r["outcome"]) for r in spark.read.parquet(sink).collect()), key=repr)
    assert found == plain_outcomes([r for r in rows if r[2]], retention)
    assert {o for _, o in found} == {"applied", "repeated", "conflict"}


SCHEMA = T.StructType().add("id", T.LongType()).add("v", T.LongType()).add("text", T.StringType())


def content(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=repr)


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("id",), "v", SCHEMA, 4)
    assert content(table, spark) == []
    rng, expected = random.Random(4), {}
    for number in range(4):
        batch = [(rng.choice([None, *range(12)]), rng.randrange(6), f"{number}-{i}") for i in range(9)]
        for i, v, text in sorted(batch, key=lambda r: (r[1], r[2])):
            if i not in expected or v >= expected[i][1]:
                expected[i] = (i, v, text)
        df = spark.createDataFrame(batch, SCHEMA)
        table.merge(df, number)
        table.merge(df, number)  # repeated after it was current
        assert content(table, spark) == sorted(expected.values(), key=repr)
    table.merge(spark.createDataFrame([(1, 99, "late")], SCHEMA), 2)  # an old number
    table.merge(spark.createDataFrame([], SCHEMA), 4)
    assert content(table, spark) == sorted(expected.values(), key=repr)
    table.vacuum(spark, 1)
    assert content(table, spark) == sorted(expected.values(), key=repr) and list(table.generations(spark)) == [4]


def test_a_merge_that_failed_half_way(spark, tmp_path, monkeypatch):
    table = KeyedTable(str(tmp_path / "t"), ("id",), "v", SCHEMA, 4)
    table.merge(spark.createDataFrame([(1, 1, "a"), (2, 1, "a")], SCHEMA), 0)
    (tmp_path / "t/data/gen=1/bucket_=0").mkdir(parents=True)  # data without the file that names them
    spark.createDataFrame([(7, 7, "lost")], SCHEMA).write.mode("overwrite").parquet(str(tmp_path / "t/data/gen=1/bucket_=3"))
    assert content(table, spark) == [(1, 1, "a"), (2, 1, "a")]
    table.merge(spark.createDataFrame([(2, 2, "b"), (3, 1, "b")], SCHEMA), 1)
    assert content(table, spark) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "b")]


def test_upsert_stream(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ("id",), "v", SCHEMA, 3)
    rows = [(i % 7, i, f"x{i}") for i in range(40)]
    for run in (rows[:20], rows[20:]):
        for i in range(0, len(run), 10):
            spark.createDataFrame(run[i : i + 10], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(jobs.upsert(table)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert content(table, spark) == sorted({i % 7: (i % 7, i, f"x{i}") for i in range(40)}.values(), key=repr)
