from __future__ import annotations

from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import scores
from furrow.operators import alerts, quality, serving
from helpers import at, event_rows

PLOT_ROW = ("WB_123_45", "WB", "Northfield", "rice", 2.25, "A. Grower", "F1")


def plots(spark, *more):
    return spark.createDataFrame([PLOT_ROW, *more], C.PLOT_DDL)


def test_status(spark):
    df = event_rows(
        spark, {"event_type": C.SATELLITE, "ndvi": 0.25},
        {"event_type": C.SATELLITE, "ndvi": 0.5, "ts": at(hours=2)},
        {"event_type": C.SOIL, "moisture_pct": 22.0, "ts": at(hours=3)})
    bare = ("UP_1_1", "UP", None, None, None, None, None)
    row, = serving.plot_status(plots(spark, bare), df, alerts.plot_alerts(df)).collect()
    assert row.plot_id == "WB_123_45" and 0 <= row.health_score <= 1
    assert [a.type for a in row.alerts] == ["low_vegetation_health", "low_soil_moisture"]
    assert row.recommendations == ["Inspect crop health", "Irrigate within 2 days"]
    assert row.last_updated == at(hours=3)


def test_lookup(spark):
    assert serving.plot_lookup(plots(spark), "WB_123_45").first().farmer_name == "A. Grower"
    assert serving.plot_lookup(plots(spark), "nowhere").count() == 0


def test_scores(spark):
    one = spark.range(1)

    def health(n, m, t):
        cols = [F.lit(x).cast("double") for x in (n, m, t)]
        return one.select(scores.health_score(*cols)).first()[0]

    assert health(0.8, 60, 20) == 1.0 and health(0.0, 0, 50) == 0.0
    assert health(None, 40, None) == 0.5 and health(None, None, None) is None
    readings = {"moisture_pct": 42.5, "ph": 6.8, "nitrogen_ppm": 285.0, "phosphorus_ppm": 28.5,
                "potassium_ppm": 220.0}

    def rating(**changes):
        cols = {k: F.lit(v).cast("double") for k, v in {**readings, **changes}.items()}
        return one.select(scores.soil_rating(cols)).first()[0]

    assert rating() == "good" and rating(ph=5.0) == "fair"
    assert rating(ph=5.0, moisture_pct=20.0, nitrogen_ppm=None) == "poor"
    assert one.select(scores.forecast_text(F.lit(35.0), F.lit(0.3))).first()[0] == (
        "Max 35.0°C, 30% chance of rain")


def alert_rows(spark):
    return spark.createDataFrame(
        [(f"a{i:02}", f"P{i % 2}", "heat_stress", "medium", "m", at(i // 2), False)
         for i in range(12)], C.ALERT_DDL)


def test_recent(spark):
    rows = serving.recent_alerts(alert_rows(spark), limit=3).collect()
    assert [r.alert_id for r in rows] == ["a10", "a11", "a08"]
    assert {r.plot_id for r in serving.recent_alerts(alert_rows(spark), "P1").collect()} == {"P1"}
    per_plot = serving.recent_alerts_per_plot(alert_rows(spark), 2).collect()
    assert sorted(r.alert_id for r in per_plot) == ["a08", "a09", "a10", "a11"]


def test_acknowledge(spark):
    acks = alert_rows(spark).filter("plot_id = 'P0'").select("alert_id")
    done = serving.acknowledge(alert_rows(spark), acks.union(acks))
    assert done.count() == 12 and done.filter("acknowledged").count() == 6
    owners = spark.createDataFrame([("P0",), ("P1",)], "plot_id string")
    open_ = serving.plots_with_open_alerts(owners, done).collect()
    assert [r.plot_id for r in open_] == ["P1"]


def test_created_alerts_can_be_read(spark):
    asked = spark.createDataFrame(
        [("UP_789_12", "weather_alert", None, "Heavy rain forecasted", at())],
        "plot_id string, alert_type string, severity string, message string, ts timestamp")
    row = serving.recent_alerts(serving.create_alerts(asked), "UP_789_12").first()
    assert (row.alert_type, row.severity, row.legacy_id) == (
        "weather_alert", "medium", "alert_UP_789_12_21")


def test_quarantine(spark):
    df = event_rows(
        spark, {"temperature_c": 30.0}, {"temperature_c": 45.0, "plot_id": None},
        {"event_type": C.MARKET, "plot_id": None, "crop": "rice", "market_location": "Pune",
         "price_per_quintal_inr": 1500.0}, {"event_type": C.MARKET, "crop": "oats"})
    judged = quality.with_reasons(df)
    assert quality.accepted(judged).count() == 2
    reasons = {r.event_uuid: r.reasons for r in quality.quarantined(judged).collect()}
    assert reasons == {
        "1": ["required:plot_id|crop", "range:weather_observation.temperature_c"],
        "3": ["member:market_price_update.crop"]}
    verdict = quality.run_verdict(quality.summary(df)).first()
    assert verdict.expectations_run - verdict.passed == 3


def test_cadence(spark):
    df = event_rows(
        spark, *[{"event_uuid": f"w{i}", "ts": at(hours=i)} for i in range(4)],
        {"event_uuid": "late", "ts": at(hours=48), "event_type": C.SOIL},
        *[{"event_uuid": c, "event_type": C.MARKET, "crop": c, "plot_id": None}
          for c in C.CROPS])
    stray = event_rows(spark, {"event_uuid": "stray", "ts": at(hours=24 * 36_500)})
    rows = quality.cadence_gaps(df.unionByName(stray), plots(spark), "2024-01-01", "2024-01-03").collect()
    gaps = {(r.source, r.reading, r.first_day, r.last_day): r.missing for r in rows}
    plot, (one, two, three) = "WB_123_45", (f"2024-01-0{d}" for d in (1, 2, 3))
    assert {k: v for k, v in gaps.items() if k[0] == plot} == {
        (plot, C.WEATHER, two, three): 8, (plot, C.SOIL, one, two): 14, (plot, C.SOIL, three, three): 6,
        (plot, C.SATELLITE, one, three): 1}
    assert gaps["rice", C.MARKET, two, three] == 2 and len(rows) == len(gaps)
