"""Named queries of issues since a release, release series and experiment verdicts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import errors, experiments, sourcemaps
from tidemark.sources import model
from tidemark.sources.model import DAY_MS, SQL_EVENTS

START_MS = 1_704_067_200_000
SINCE, TODAY = START_MS + 12 * DAY_MS, START_MS + 17 * DAY_MS + 5_000_000
_ERRORS = f"""WITH {SQL_EVENTS}, er AS (
  SELECT event_id, ts_ms, session_id, release, CASE WHEN k % 10 = 0 THEN 'fatal' WHEN k % 10 < 3 THEN 'warning' ELSE 'error' END AS level, k // 20 AS kind,
    md5(concat('E', k // 20, '|', regexp_replace(concat('cannot load item 1000', k, ' for user', CAST(distinct_id AS BIGINT) % 5), '\\b[0-9]{{6,}}\\b', '{{num}}', 'g'))) AS group_hash
  FROM ev WHERE event_type = 'error')"""


def _since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of type E1 are merged into the smallest of them; all groups but E4's are known issues."""
    er = model.errors(spark, sf_dir)
    groups = er.select("error_type", errors.group_hash(F.col("error_type"), F.col("message")).alias("group_hash")).distinct()
    target = groups.filter("error_type = 'E1'").agg(F.min("group_hash").alias("canonical"))
    merges = groups.filter("error_type = 'E1'").join(F.broadcast(target)).filter("group_hash <> canonical").select(F.col("group_hash").alias("alias"), "canonical")  # one row
    statuses = groups.filter("error_type <> 'E4'").select(F.col("group_hash").alias("issue"), F.when(F.col("error_type") == "E0", "resolved").otherwise("unresolved").alias("status"))
    return errors.counted_since(er, statuses, merges, SINCE, "1.1")


def _sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.struct("ts_ms", "event_id")
    sessions = model.events(spark, sf_dir).groupBy("session_id").agg(F.min("ts_ms").alias("first_ms"), F.min_by("release", at).alias("release"))
    return errors.release_sparkline(model.errors(spark, sf_dir), sessions, "1.0", TODAY, 16).withColumn("crash_free_pct", F.round("crash_free_pct", 6))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits in three arms by person; the more its highest k exceeds a bound that the arm sets, the better."""
    arm = F.col("distinct_id").cast("long") % 3
    of = model.events(spark, sf_dir).groupBy("visit_id", "distinct_id").agg(F.max("k").alias("top"))
    return of.select(F.element_at(F.array(*map(F.lit, "abc")), (arm + 1).cast("int")).alias("variant"), (F.col("top") >= 80 - 15 * arm).cast("double").alias("hit"), F.col("top").cast("double").alias("top"))


def _verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = experiments.arms(_values(spark, sf_dir).withColumnRenamed("hit", "value"))
    out = experiments.verdict(table, "a", {"a": 1, "b": 1, "c": 1}, 20)
    return out.select("variant", "n", F.round("mean", 6).alias("mean"), F.round("lift", 6).alias("lift"), F.coalesce("significant", F.lit(False)).alias("significant"), "winner", "test", "horizon_met", "ratio_broken")


def _continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = experiments.arms(_values(spark, sf_dir).withColumnRenamed("top", "value"))
    out = experiments.verdict(table, "b", required=1_000_000, binary=False)
    return out.select("variant", "n", F.round("mean", 6).alias("mean"), F.round("lift", 6).alias("lift"), "winner", "test", "horizon_met")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of events in built files, of which one file has a map in each release: ten lines of three segments."""
    ev = model.events(spark, sf_dir)
    mappings = "AAAAA,K,KACA" + ";AACA,K,KACA" * 9
    text = F.concat(F.lit('{"version":3,"names":["main"],"sources":["src/'), "release", F.lit(f'.ts"],"mappings":"{mappings}"}}'))
    maps = ev.select("release").distinct().select("release", F.lit("static/app.js").alias("file"), text.alias("map"))
    file = F.when(F.col("event_id") % 5 == 0, "other.js").otherwise(F.concat(F.lit("https://cdn.example.org/static/app.js?v="), F.col("k") % 3))
    frames = ev.select("event_id", "release", file.alias("file"), (F.col("k") % 12 + 1).cast("int").alias("line"), (F.col("event_id") % 30 + 1).cast("int").alias("column"))
    return sourcemaps.resolved(frames, maps).select("event_id", "source", "source_line", "source_column", "name")


_VALUES = f"WITH {SQL_EVENTS}" + """, v AS (
  SELECT ['a', 'b', 'c'][CAST(distinct_id AS BIGINT) % 3 + 1] AS variant, max(k) >= 80 - 15 * (CAST(distinct_id AS BIGINT) % 3) AS hit, max(k) AS top FROM ev GROUP BY visit_id, distinct_id
)"""

QUERIES = {"issue_since": _since, "release_sparkline": _sparkline, "experiment_verdict": _verdict, "experiment_verdict_means": _continuous, "source_frames": _frames}
ORACLE_SQL = {
    "issue_since": f"""{_ERRORS}, m AS (SELECT group_hash AS alias, (SELECT min(group_hash) FROM er WHERE kind = 1) AS canonical FROM (SELECT DISTINCT group_hash FROM er WHERE kind = 1)),
  x AS (SELECT er.*, coalesce(m.canonical, er.group_hash) AS issue FROM er LEFT JOIN m ON m.alias = er.group_hash)
SELECT issue, if(any_value(kind) = 0, 'resolved', 'unresolved') AS status, count(*) FILTER (ts_ms >= {SINCE}) AS events_since, count(*) FILTER (ts_ms >= {SINCE} AND release = '1.1') AS events_since_in_release,
  max(ts_ms) AS last_ms, arg_min(release, (-ts_ms, event_id)) AS latest_release FROM x WHERE kind <> 4 GROUP BY issue""",
    "release_sparkline": f"""{_ERRORS}, s AS (SELECT session_id, min(ts_ms) AS first_ms, arg_min(release, (ts_ms, event_id)) AS release FROM ev GROUP BY 1),
  d AS (SELECT unnest(range({TODAY // DAY_MS - 15}, {TODAY // DAY_MS + 1})) * {DAY_MS} AS day_ms),
  b AS (SELECT DISTINCT session_id FROM er WHERE level IN ('error', 'fatal') AND ts_ms >= (SELECT min(day_ms) FROM d) AND ts_ms < (SELECT max(day_ms) FROM d) + {DAY_MS}),
  c AS (SELECT first_ms // {DAY_MS} * {DAY_MS} AS day_ms, count(*) AS sessions, count(b.session_id) AS crashed FROM s LEFT JOIN b USING (session_id) WHERE release = '1.0' GROUP BY 1)
SELECT day_ms, coalesce(sessions, 0) AS sessions, coalesce(crashed, 0) AS crashed, round(CASE WHEN sessions > 0 THEN (sessions - crashed) * 100 / sessions ELSE 0 END, 6) AS crash_free_pct FROM d LEFT JOIN c USING (day_ms)""",
    # Chi-square with two degrees of freedom has p = exp(-x / 2); 3.841459 and 5.023886 have p = 0.05 and 0.025 with one.
    "experiment_verdict": _VALUES + """, a AS (SELECT variant, count(*)::DOUBLE AS n, count(*) FILTER (hit)::DOUBLE AS k FROM v GROUP BY 1), t AS (SELECT sum(n) AS n, sum(k) / sum(n) AS s FROM a),
  o AS (SELECT exp(-sum(power(k - a.n * s, 2) / (a.n * s) + power(k - a.n * s, 2) / (a.n * (1 - s))) / 2) AS p, exp(-sum(power(a.n - t.n / 3, 2) / (t.n / 3)) / 2) AS ratio_p, min(a.n) >= 20 AS horizon FROM a, t),
  c AS (SELECT n, k FROM a WHERE variant = 'a'),
  q AS (SELECT a.variant, power(greatest(abs(a.k - a.n * (a.k + c.k) / (a.n + c.n)) - 0.5, 0), 2) * (1 / (a.n * (a.k + c.k) / (a.n + c.n)) + 1 / (c.n * (a.k + c.k) / (a.n + c.n)) + 1 / (a.n * (1 - (a.k + c.k) / (a.n + c.n))) + 1 / (c.n * (1 - (a.k + c.k) / (a.n + c.n)))) AS x FROM a, c WHERE a.variant <> 'a'),
  g AS (SELECT variant, (SELECT max(x) FROM q) >= 5.023886187314888 AND (x >= 3.841458820694124 OR x = (SELECT max(x) FROM q)) AS significant FROM q),
  best AS (SELECT arg_max(variant, k / n) AS variant FROM a WHERE variant <> 'a')
SELECT a.variant, a.n::BIGINT AS n, round(a.k / a.n, 6) AS mean, CASE WHEN a.variant <> 'a' THEN round(a.k / a.n - c.k / c.n, 6) END AS lift, coalesce(g.significant, false) AS significant,
  a.variant = best.variant AND a.k / a.n > c.k / c.n AND coalesce(g.significant, false) AND o.p < 0.05 AND o.horizon AND o.ratio_p >= 0.001 AS winner, 'chi-square' AS test, o.horizon AS horizon_met, o.ratio_p < 0.001 AS ratio_broken
FROM a LEFT JOIN g USING (variant), c, o, best""",
    "source_frames": f"""WITH {SQL_EVENTS}, f AS (SELECT event_id, release, k % 12 + 1 AS line, event_id % 30 AS col, event_id % 5 <> 0 AND k % 12 < 10 AND event_id % 30 NOT BETWEEN 5 AND 9 AS hit FROM ev)
SELECT event_id, CASE WHEN hit THEN concat('src/', release, '.ts') END AS source, CASE WHEN hit THEN CAST(2 * line - if(col < 5, 1, 0) AS INT) END AS source_line, CASE WHEN hit THEN 1::INT END AS source_column, CASE WHEN hit AND line = 1 AND col < 5 THEN 'main' END AS name FROM f""",
    "experiment_verdict_means": _VALUES + """, a AS (SELECT variant, count(*) AS n, avg(top) AS mean FROM v GROUP BY 1)
SELECT variant, n, round(mean, 6) AS mean, CASE WHEN variant <> 'b' THEN round(mean - (SELECT mean FROM a WHERE variant = 'b'), 6) END AS lift, false AS winner, 'welch-t' AS test, false AS horizon_met FROM a""",
}
