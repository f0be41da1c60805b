"""Order-sensitive figures per entity: funnels, retention, journeys, attribution and correlation.

Nothing gathers an entity's events in one value: steps are found by joins and minima that combine map-side, so an
entity with any number of events is no single row. Order is (ts_ms, event_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at() -> Column:
    return F.struct("ts_ms", "event_id")


def funnel_depth(events: DataFrame, steps: list[Column], entity: str = "session_id", window_ms: int | None = None, exclude: Column | None = None) -> DataFrame:
    """(entity, depth): steps reached in order by every entity that reached the first.

    Each next step is the earliest matching event after the one before. All lie within window_ms of the first,
    inclusive; the first excluded event after it ends the entity. A repeated step needs events of its own.
    """
    known = events.filter(F.col(entity) != "")
    state = known.filter(steps[0]).groupBy(entity).agg(F.min(_at()).alias("first")).withColumn("at", F.col("first"))
    end = F.lit(None).cast(state.schema["first"].dataType)
    if exclude is not None:
        stops = known.filter(exclude).select(F.col(entity).alias("e"), _at().alias("x"))
        met = state.join(stops, (F.col(entity) == F.col("e")) & (F.col("x") > F.col("first")), "left")
        state = met.groupBy(entity, "first", "at").agg(F.min("x").alias("end"))
    else:
        state = state.withColumn("end", end)
    state = state.withColumn("depth", F.lit(1))
    for i, step in enumerate(steps[1:], 1):
        after = known.filter(step).select(F.col(entity).alias("e"), _at().alias("x"))
        fits = (F.col(entity) == F.col("e")) & (F.col("depth") == i) & (F.col("x") > F.col("at")) & (F.col("end").isNull() | (F.col("x") < F.col("end")))
        if window_ms is not None and window_ms > 0:
            fits = fits & (F.col("x.ts_ms") <= F.col("first.ts_ms") + window_ms)
        met = state.join(after, fits, "left").groupBy(entity, "first", "end", "at", "depth").agg(F.min("x").alias("x"))
        state = met.select(entity, "first", "end", F.coalesce("x", "at").alias("at"), (F.col("depth") + F.col("x").isNotNull().cast("int")).alias("depth"))
    return state.select(entity, "depth", "first")


def funnel(events: DataFrame, steps: list[Column], **options) -> DataFrame:
    """(step, entities): how many entities reached each step."""
    depth = funnel_depth(events, steps, **options)
    counts = depth.agg(*[F.count_if(F.col("depth") >= i).alias(str(i)) for i in range(1, len(steps) + 1)])
    return counts.select(F.posexplode(F.array(*counts.columns)).alias("step", "entities")).withColumn("step", F.col("step") + 1)


def funnel_breakdown(events: DataFrame, steps: list[Column], dimension: str, entity: str = "session_id", min_size: int = 5, **options) -> DataFrame:
    """(group, step, entities): funnels by the dimension of each entity's first event; small groups are left out."""
    groups = events.groupBy(entity).agg(F.min_by(dimension, _at()).alias("group"))
    depth = funnel_depth(events, steps, entity=entity, **options).join(groups, entity)
    reached = [F.count_if(F.col("depth") >= i).alias(f"s{i}") for i in range(1, len(steps) + 1)]
    counts = depth.groupBy("group").agg(*reached).filter(F.col("s1") >= min_size)
    return counts.select("group", F.posexplode(F.array(*[f"s{i}" for i in range(1, len(steps) + 1)])).alias("step", "entities")).withColumn("step", F.col("step") + 1)


def retention(events: DataFrame, period_ms: int, end_ms: int, entity: str = "session_id", periods: int = 12) -> DataFrame:
    """(cohort_ms, size, period, retained): share of a first-activity cohort seen again p whole periods later.

    Only periods that have ended by end_ms are reported, at most so many; period 0 is left out.
    """
    active = events.filter(F.col(entity) != "").select(F.col(entity).alias("e"), F.expr(f"ts_ms div {period_ms}").alias("b")).distinct()
    first = active.groupBy("e").agg(F.min("b").alias("c"))
    sizes = first.groupBy("c").agg(F.count("*").alias("size"))
    again = active.join(first, "e").filter("b > c").groupBy("c", (F.col("b") - F.col("c")).alias("period")).agg(F.count("*").alias("retained"))
    last = F.least(F.lit(periods), F.lit(end_ms // period_ms) - 1 - F.col("c"))
    spine = sizes.filter(last >= 1).select("c", "size", F.explode(F.sequence(F.lit(1).cast("long"), last.cast("long"))).alias("period"))
    joined = spine.join(again, ["c", "period"], "left")
    return joined.select((F.col("c") * period_ms).alias("cohort_ms"), "size", "period", F.coalesce("retained", F.lit(0)).alias("retained"))


def _visits(events: DataFrame, entity: str) -> DataFrame:
    """Pageviews in order without those that repeat the page before, for entities with at least two left."""
    order = Window.partitionBy(entity).orderBy("ts_ms", "event_id")
    views = events.filter("event_type = 'pageview'").withColumn("before", F.lag("pathname").over(order))
    kept = views.filter(~F.col("pathname").eqNullSafe(F.col("before")))
    longer = kept.groupBy(entity).agg(F.count("*").alias("pages")).filter("pages >= 2").select(entity)
    return kept.join(longer, entity, "left_semi")


def journey_edges(events: DataFrame, entity: str = "session_id") -> DataFrame:
    """(source, target, transitions) over consecutive different pages."""
    order = Window.partitionBy(entity).orderBy("ts_ms", "event_id")
    steps = _visits(events, entity).select(F.col("pathname").alias("source"), F.lead("pathname").over(order).alias("target"))
    return steps.filter("target is not null").groupBy("source", "target").agg(F.count("*").alias("transitions"))


def journey_paths(events: DataFrame, entity: str = "session_id", length: int = 5) -> DataFrame:
    """(path, entities): the first pages of each journey."""
    order = Window.partitionBy(entity).orderBy("ts_ms", "event_id")
    first = _visits(events, entity).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= length)
    paths = first.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("n", "pathname"))).alias("steps"))
    joined = F.array_join(F.transform("steps", lambda s: s["pathname"]), " > ")
    return paths.groupBy(joined.alias("path")).agg(F.count("*").alias("entities"))


def attribution(events: DataFrame, model: str) -> DataFrame:
    """(source, credit): each session's credit to its first, last or all (linear) campaign sources, else '(direct)'."""
    named = F.when(F.col("utm_source") != "", F.col("utm_source"))
    if model in ("first", "last"):
        pick = F.min_by if model == "first" else F.max_by
        per_session = events.groupBy("session_id").agg(pick(named, F.when(named.isNotNull(), _at())).alias("source"))
        return per_session.groupBy(F.coalesce("source", F.lit("(direct)")).alias("source")).agg(F.count("*").cast("double").alias("credit"))
    if model != "linear":
        raise ValueError(model)
    pairs = events.select("session_id", named.alias("source")).distinct()
    some = pairs.filter("source is not null")
    share = some.groupBy("session_id").agg((1.0 / F.count("*")).alias("credit"))
    direct = pairs.join(share, "session_id", "left_anti").select("session_id", F.lit("(direct)").alias("source"), F.lit(1.0).alias("credit"))
    return some.join(share, "session_id").unionByName(direct).groupBy("source").agg(F.sum("credit").alias("credit"))


def correlation(events: DataFrame, dimensions: list[str], target: str, min_sessions: int = 5, n: int = 20) -> DataFrame:
    """(property, value, occurrences, conversions, rate, baseline_rate, uplift, significant): the n largest uplifts.

    A session counts once for its last value of each dimension and of each property in props (JSON). Rates are in
    percent; uplift is the rate's distance to that of all sessions, in percent of it. significant: at least 10 sessions
    of 20, and a pooled two-proportion score above 1.96 against the others.
    """
    named = [F.struct(F.lit(d).alias("property"), F.col(d).cast("string").alias("value")) for d in dimensions]
    of_json = F.transform(F.map_entries(F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("property"), e["value"].alias("value")))
    each = events.select("session_id", _at().alias("at"), F.explode(F.concat(F.array(*named), of_json)).alias("x")).filter("x.value <> ''")
    last = each.groupBy("session_id", F.col("x.property").alias("property")).agg(F.max_by("x.value", "at").alias("value"))
    sessions = events.groupBy("session_id").agg(F.bool_or(F.col("event_type") == target).cast("long").alias("hit"))
    total = sessions.agg(F.count("*").alias("all_n"), F.coalesce(F.sum("hit"), F.lit(0)).alias("all_hits"))
    found = last.join(sessions, "session_id").groupBy("property", "value").agg(F.count("*").alias("occurrences"), F.sum("hit").alias("conversions")).filter(F.col("occurrences") >= min_sessions)
    both = found.join(F.broadcast(total))  # one row
    n1, n2, k1 = F.col("occurrences"), F.col("all_n") - F.col("occurrences"), F.col("conversions")
    p, rate = F.col("all_hits") / F.col("all_n"), k1 / n1
    z = F.try_divide(F.abs(rate - F.try_divide(F.col("all_hits") - k1, n2)), F.sqrt(p * (1 - p) * (1 / n1 + F.try_divide(F.lit(1.0), n2))))
    uplift = F.round(F.when(p > 0, (rate - p) / p * 100).otherwise(0.0), 1)
    out = both.select(
        "property", "value", "occurrences", "conversions", F.round(rate * 100, 1).alias("rate"), F.round(p * 100, 1).alias("baseline_rate"), uplift.alias("uplift"),
        ((n1 >= 10) & (F.col("all_n") >= 20) & F.coalesce(z > 1.96, F.lit(False))).alias("significant"),
    )
    return out.orderBy(F.desc(F.abs("uplift")), "property", "value").limit(n)
