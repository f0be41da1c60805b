"""Alert figures over a window, and the states, incidents and notices of rules over their evaluations.

streaming.alerts is the same machine over a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.logs import level_is

#: Notices of an incident.
OPENED, REPEAT, RECOVERED = "incident_opened", "incident_repeat", "incident_recovered"


def figures(events: DataFrame, errors: DataFrame, spans: DataFrame, logs: DataFrame, checks: DataFrame) -> DataFrame:
    """(figure, value, samples) of a window's rows, a row per figure; without samples there is no figure but 0.

    Pageviews, visitors (of all events), error_count and error_rate count events as samples, trace_error_rate spans,
    trace_p95_ms root spans, log_error_count all logs, uptime_failures all checks (is_up). Rates are in percent.
    """
    of_events = events.agg(F.count_if(F.col("event_type") == "pageview").alias("pageviews"), F.count_distinct("session_id").alias("visitors"), F.count("*").alias("events"))
    of_errors = errors.agg(F.count("*").alias("errors"))
    root = F.coalesce(F.col("parent_span_id").cast("string"), F.lit("")) == ""
    of_spans = spans.agg(F.count("*").alias("spans"), F.count_if("is_error").alias("bad_spans"), F.count_if(root).alias("roots"), F.percentile(F.when(root, F.col("duration_ms")), 0.95).alias("p95"))
    of_logs = logs.agg(F.count("*").alias("logs"), F.count_if(level_is("error") | level_is("fatal")).alias("bad_logs"))
    of_checks = checks.agg(F.count("*").alias("checks"), F.count_if(~F.col("is_up")).alias("failures"))
    row = reduce(lambda a, b: a.join(F.broadcast(b)), (of_events, of_errors, of_spans, of_logs, of_checks))  # one row each
    found = {
        "pageviews": (F.col("pageviews"), "events"), "visitors": (F.col("visitors"), "events"), "error_count": (F.col("errors"), "events"), "error_rate": (F.try_divide(F.col("errors") * 100.0, F.col("events")), "events"),
        "trace_error_rate": (F.try_divide(F.col("bad_spans") * 100.0, F.col("spans")), "spans"), "trace_p95_ms": (F.round("p95"), "roots"), "log_error_count": (F.col("bad_logs"), "logs"), "uptime_failures": (F.col("failures"), "checks"),
    }
    pairs = [F.struct(F.lit(name).alias("figure"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"), F.col(samples).alias("samples")) for name, (value, samples) in found.items()]
    return row.select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def state() -> Column:
    """State of an evaluation (value, samples, operator, threshold, min_samples).

    Without a value it is unavailable; with fewer samples than the rule asks for (one at least) no_data; else firing
    where the operator gt, gte, lt, lte or eq holds, and healthy.
    """
    value, threshold, operator = F.col("value"), F.col("threshold"), F.col("operator")
    tests = {"gt": value > threshold, "gte": value >= threshold, "lt": value < threshold, "lte": value <= threshold, "eq": value == threshold}
    breached = reduce(lambda a, b: a | b, [(operator == name) & test for name, test in tests.items()])
    least = F.greatest(F.coalesce(F.col("min_samples"), F.lit(0)), F.lit(1))
    enough = F.coalesce(F.col("samples"), F.lit(0)) >= least
    return F.when(value.isNull(), "unavailable").when(~enough, "no_data").when(F.coalesce(breached, F.lit(False)), "firing").otherwise("healthy")


def incidents(evaluations: DataFrame, silence_ms: int | None = None, until_ms: int | None = None) -> DataFrame:
    """evaluations with from_state, state, incident_ms and notice, one row per rule and ts_ms.

    evaluations: rule, ts_ms, value, samples, operator, threshold, min_samples, cooldown_min. An incident is named by the
    time of the firing evaluation that opened it and ends at the next healthy one; unavailable and no_data decide
    nothing. Firing again repeats the notice once cooldown_min minutes have passed since the last one, never where it is
    0. With silence_ms a rule that is not evaluated for longer than that has an unavailable row then; after its last
    evaluation only if that time is before until_ms.
    """
    rules = Window.partitionBy("rule").orderBy("ts_ms")
    before, upto = rules.rowsBetween(Window.unboundedPreceding, -1), rules.rowsBetween(Window.unboundedPreceding, 0)
    rows = evaluations.select("rule", "ts_ms", "value", "samples", state().alias("state"), (F.coalesce("cooldown_min", F.lit(0)) * 60_000).cast("long").alias("cooldown_ms"))
    if silence_ms is not None:
        following = F.lead("ts_ms").over(rules)
        silent = F.coalesce(following > F.col("ts_ms") + silence_ms, F.lit(until_ms) > F.col("ts_ms") + silence_ms if until_ms is not None else F.lit(False))
        gaps = rows.withColumn("silent", silent).filter("silent").select("rule", (F.col("ts_ms") + silence_ms).alias("ts_ms"), F.lit(None).cast("double").alias("value"), F.lit(0).cast("long").alias("samples"), F.lit("unavailable").alias("state"), "cooldown_ms")
        rows = rows.withColumn("samples", F.col("samples").cast("long")).unionByName(gaps)
    sure = F.when(F.col("state").isin("firing", "healthy"), F.col("state"))
    known = rows.withColumn("sure", sure).withColumn("was", F.last("sure", ignorenulls=True).over(before)).withColumn("from_state", F.coalesce(F.lag("state").over(rules), F.lit("")))
    opens = (F.col("state") == "firing") & (F.coalesce("was", F.lit("healthy")) == "healthy")
    marked = known.withColumn("opens", opens).withColumn("closes", (F.col("state") == "healthy") & (F.coalesce("was", F.lit("")) == "firing"))
    inside = F.col("opens") | (F.coalesce("was", F.lit("")) == "firing")
    of = marked.withColumn("incident_ms", F.when(inside, F.last(F.when(F.col("opens"), F.col("ts_ms")), ignorenulls=True).over(upto)))
    times = of.filter((F.col("state") == "firing") & (F.col("cooldown_ms") > 0)).groupBy("rule", "incident_ms").agg(F.array_sort(F.collect_list("ts_ms")).alias("all"), F.max("cooldown_ms").alias("c"))
    kept = F.aggregate("all", F.slice("all", 1, 1), lambda out, t: F.when(t >= F.element_at(out, -1) + F.col("c"), F.concat(out, F.array(t))).otherwise(out))
    repeats = times.select("rule", F.explode(F.slice(kept, 2, F.size("all"))).alias("ts_ms")).withColumn("repeats", F.lit(True))
    notice = F.when(F.col("opens"), OPENED).when(F.col("closes"), RECOVERED).when(F.col("repeats"), REPEAT).otherwise("")
    return of.join(repeats, ["rule", "ts_ms"], "left").select("rule", "ts_ms", "value", "samples", "from_state", "state", "incident_ms", notice.alias("notice"))
