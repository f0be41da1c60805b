"""Named queries of schedules, durations and currencies, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.schedules import DAY_MS, deadline_ms, minor_unit_scale, step_ms, window_ms
from tidemark.sources import model
from tidemark.sources.model import SQL_EVENTS

STEPS = ["", "15s", "1d", "10m", "1h30m", "1.5h", "25h", "100us", "x"]
WINDOWS = ["d", "h", "M ", "x", ""]
CURRENCIES = ["USD", "jpy", "KWD", "CLF", "?"]


def _one_of(values: list[str], number: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (number % len(values)).cast("int"))


def monitor_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's monitor is late: on workdays at 6:30, every 90 minutes, or by grace alone."""
    last = model.events(spark, sf_dir).groupBy("distinct_id").agg(F.max("ts_ms").alias("last_ms"))
    kind, at = F.col("distinct_id").cast("long") % 3, F.col("last_ms")
    late = F.when(kind == 0, deadline_ms("30 6 * * mon-fri", at, 60)).when(kind == 1, deadline_ms("@every 1h30m", at)).otherwise(deadline_ms("", at, 0))
    return last.select("distinct_id", "last_ms", late.alias("late_ms"))


def metric_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = step_ms(_one_of(STEPS, F.col("event_id")))
    return model.events(spark, sf_dir).groupBy(step.alias("step_ms")).agg(F.count("*").alias("n"))


def cohort_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = window_ms(F.concat((F.col("event_id") % 40).cast("string"), _one_of(WINDOWS, F.col("event_id"))))
    return model.events(spark, sf_dir).groupBy(window.alias("window_ms")).agg(F.count("*").alias("n"))


def revenue_minor_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("currency", _one_of(CURRENCIES, F.col("o_orderkey")))
    amount = F.round(F.col("o_totalprice").cast("decimal(18,4)") * minor_unit_scale(F.col("currency"))).cast("long")
    return orders.groupBy("currency").agg(F.sum(amount).alias("minor_units"))


QUERIES = {f.__name__: f for f in (monitor_deadlines, metric_steps, cohort_windows, revenue_minor_units)}
ORACLE_SQL = {
    "monitor_deadlines": f"""WITH {SQL_EVENTS}, l AS (SELECT distinct_id, max(ts_ms) AS last_ms FROM ev GROUP BY 1),
  w AS (SELECT distinct_id, min((last_ms // {DAY_MS} + i) * {DAY_MS} + 23400000) AS run FROM l, range(8) t(i)
    WHERE (last_ms // {DAY_MS} + i + 4) % 7 BETWEEN 1 AND 5 AND (last_ms // {DAY_MS} + i) * {DAY_MS} + 23400000 > last_ms GROUP BY 1)
SELECT distinct_id, last_ms, CASE CAST(distinct_id AS BIGINT) % 3 WHEN 0 THEN run + 60000 WHEN 1 THEN last_ms + 5400000 + 300000 ELSE last_ms + 300000 END AS late_ms FROM l JOIN w USING (distinct_id)""",
    "metric_steps": f"""WITH {SQL_EVENTS} SELECT CAST(([60000, 15000, 86400000, 600000, 5400000, 5400000, NULL, NULL, NULL])[event_id % 9 + 1] AS BIGINT) AS step_ms, count(*) AS n FROM ev GROUP BY 1""",
    "cohort_windows": f"""WITH {SQL_EVENTS}, w AS (SELECT event_id % 40 AS x, ([{DAY_MS}, 3600000, 60000, NULL, NULL])[event_id % 5 + 1] AS unit FROM ev)
SELECT CAST(if(x > 0, x * unit, NULL) AS BIGINT) AS window_ms, count(*) AS n FROM w GROUP BY 1""",
    "revenue_minor_units": """WITH o AS (SELECT (['USD', 'jpy', 'KWD', 'CLF', '?'])[o_orderkey % 5 + 1] AS currency, ([100, 1, 1000, 10000, 100])[o_orderkey % 5 + 1] AS scale, CAST(o_totalprice AS DECIMAL(18, 4)) AS amount FROM orders)
SELECT currency, CAST(sum(CAST(round(amount * scale) AS BIGINT)) AS BIGINT) AS minor_units FROM o GROUP BY 1""",
}
