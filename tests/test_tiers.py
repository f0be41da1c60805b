"""Which table answers, what it covers, and that answers agree where raw events still cover a period."""

import pytest

from tidemark.operators import rollups, tiers, traffic
from tidemark.sources.model import DAY_MS, HOUR_MS

NOW = 1000 * DAY_MS


@pytest.fixture(scope="module")
def site(spark):
    rows = [(i, NOW - (i * 7 + 1) * HOUR_MS, f"s{i // 3}", f"v{i // 2}", "pageview" if i % 4 else "click", f"/{i % 3}", "Chrome" if i % 2 else "Edge", "DE") for i in range(1500)]
    ev = spark.createDataFrame(rows, "event_id long, ts_ms long, session_id string, visit_id string, event_type string, pathname string, browser string, country string").cache()
    return ev, tiers.Tiers(ev, rollups.hourly(ev), rollups.daily(ev), traffic.sessions(ev))


def test_tables_by_length_and_columns(site):
    _, t = site
    at = lambda hours, **f: t.pageview_table(NOW - hours * HOUR_MS, NOW, f)
    assert [at(h) for h in (1, 24, 25, 168, 169, 4000)] == ["events", "events", "stats_hourly", "stats_hourly", "stats_daily", "stats_daily"]
    assert [at(100, pathname="/1"), at(1000, pathname="/1"), at(100, browser="Edge"), at(1000, browser="Edge"), at(100, session_id="x"), at(100, browser="")] == ["stats_hourly", "events", "events", "stats_daily", "events", "stats_hourly"]
    assert tiers.subset(t.sessions, {"browser": "a", "pathname": "b"}) == {"browser": "a"}


@pytest.mark.parametrize("days", [1, 3, 7, 8, 60, 150])
@pytest.mark.parametrize("filters", [{}, {"browser": "Edge"}, {"pathname": "/1"}])
def test_tiers_agree_with_raw(site, days, filters):
    ev, t = site
    start = NOW - days * DAY_MS
    raw = traffic.where(ev, filters | {"event_type": "pageview"}, start_ms=start, end_ms=NOW)
    assert t.pageviews(start, NOW, filters).first()["pageviews"] == raw.count()
    if days <= 30:
        assert t.visitors(start, NOW, NOW, filters).first()["visitors"] == raw.select("session_id").distinct().count()


def test_coverage(site, spark):
    _, t = site
    of = lambda days, filters=None, **kept: tiers.Tiers(t.events, t.hourly, t.daily, t.sessions, **kept).coverage(NOW - days * DAY_MS, NOW, filters)
    assert (of(30).source, of(30).exact, of(31).source, of(31).exact, of(90).exact) == ("events", True, "sessions", True, True)
    late = of(91)
    assert (late.source, late.exact, late.covered_from_ms, late.covered_days) == ("sessions", False, NOW - 90 * DAY_MS, 90) and "90 days" in late.note and "Pageviews" in late.note
    forced = of(40, {"pathname": "/1"})
    assert (forced.source, forced.exact, forced.covered_from_ms) == ("events", False, NOW - 30 * DAY_MS) and "filter" in forced.note
    assert of(40, {"browser": "Edge"}).source == "sessions" and of(400, raw_days=0).source == "events" and of(400, session_days=0) == tiers.Coverage("sessions", True, NOW - 400 * DAY_MS)
    young = tiers.Tiers(t.events, t.hourly, t.daily.filter(f"bucket_ms >= {NOW - 50 * DAY_MS}"), t.sessions).coverage(NOW - 365 * DAY_MS, NOW)
    assert young == tiers.Coverage("sessions", True, NOW - 50 * DAY_MS)
    empty = tiers.Tiers(t.events, t.hourly, t.daily.limit(0), t.sessions).coverage(NOW - 365 * DAY_MS, NOW)
    assert empty == tiers.Coverage("sessions", True, NOW - 365 * DAY_MS)
    with pytest.raises(ValueError):
        t.pageviews(NOW, NOW)
