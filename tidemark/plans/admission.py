"""Named query of admission outcomes, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import model
from tidemark.sources.model import SQL_EVENTS
from tidemark.streaming import ledger


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under names that three share, of two producers; every tenth without a name. The type is the payload."""
    ev = model.events(spark, sf_dir)
    name = F.when(F.col("event_id") % 10 != 4, F.concat(F.lit("e"), F.floor(F.col("event_id") / 3)))
    rows = ev.select(F.lit("s").alias("site"), F.concat(F.lit("p"), F.col("event_id") % 2).alias("producer"), name.alias("event_id"), "ts_ms", F.concat_ws("|", "event_type", F.col("k") % 2).alias("payload"))
    return ledger.outcomes(rows).groupBy("producer", "event_id", "outcome").agg(F.count("*").alias("rows"), F.min("ts_ms").alias("first_ms"))


QUERIES = {"ingest_outcomes": _outcomes}
ORACLE_SQL = {
    "ingest_outcomes": f"""WITH {SQL_EVENTS}, r AS (SELECT concat('p', event_id % 2) AS producer, CASE WHEN event_id % 10 <> 4 THEN concat('e', event_id // 3) END AS event_id, ts_ms, sha256(concat(event_type, '|', k % 2)) AS digest FROM ev),
  o AS (SELECT *, row_number() OVER w AS n, first_value(digest) OVER w AS first FROM r WINDOW w AS (PARTITION BY producer, event_id ORDER BY ts_ms, digest))
SELECT producer, event_id, CASE WHEN event_id IS NULL OR n = 1 THEN 'applied' WHEN digest = first THEN 'repeated' ELSE 'conflict' END AS outcome, count(*) AS "rows", min(ts_ms) AS first_ms FROM o GROUP BY 1, 2, 3""",
}
