from __future__ import annotations

from furrow import contracts as C
from furrow.operators import alerts
from helpers import at, event_rows


def kinds(df):
    return [r.alert_type for r in df.collect()]


def test_means_at_the_threshold_raise_nothing(spark):
    df = event_rows(
        spark,
        # 0.1 + 0.2 + 0.6 and the like must not fall below by rounding
        {"event_type": C.SATELLITE, "ndvi": 0.1}, {"event_type": C.SATELLITE, "ndvi": 0.2},
        {"event_type": C.SATELLITE, "ndvi": 0.6},
        {"event_type": C.SOIL, "moisture_pct": 25.0},
        {"event_type": C.WEATHER, "temperature_c": 38.0},
    )
    assert kinds(alerts.plot_alerts(df)) == []


def test_all_three_in_order(spark):
    df = event_rows(
        spark,
        {"event_type": C.SATELLITE, "ndvi": 0.299},
        {"event_type": C.SOIL, "moisture_pct": 24.9},
        {"event_type": C.WEATHER, "temperature_c": 38.1},
    )
    rows = alerts.plot_alerts(df).collect()
    assert [(r.alert_type, r.severity, r.message) for r in rows] == [
        ("low_vegetation_health", "high", "Low NDVI detected: 0.30"),
        ("low_soil_moisture", "critical", "Irrigation needed: moisture at 24.9%"),
        ("heat_stress", "medium", "Heat stress warning: 38.1°C"),
    ]
    assert {r.window_end for r in rows} == {at(hours=1)}
    assert {r.plot_id for r in rows} == {"WB_123_45"}


def test_window_edge(spark):
    df = event_rows(
        spark,
        {"event_type": C.SATELLITE, "ndvi": 0.25, "ts": at(59, micros=59_999_999)},
        {"event_type": C.SATELLITE, "ndvi": 0.25, "ts": at(hours=1)},
    )
    ends = sorted(r.window_end for r in alerts.plot_alerts(df).collect())
    assert ends == [at(hours=1), at(hours=2)]


def test_soil_dampens_heat_unless_left_out(spark):
    df = event_rows(
        spark,
        {"event_type": C.WEATHER, "temperature_c": 40.0},
        {"event_type": C.SOIL, "temperature_c": 32.0},
    )
    assert kinds(alerts.plot_alerts(df)) == []
    assert kinds(alerts.air_heat_alerts(df)) == ["heat_stress"]


def test_missing_values_and_keys(spark):
    df = event_rows(
        spark,
        {"event_type": C.SATELLITE},
        {"event_type": C.SATELLITE, "ndvi": 0.2, "plot_id": None},
        {"event_type": C.SATELLITE, "ndvi": float("nan"), "plot_id": None},
        {"event_type": C.REPORT, "ndvi": 0.1},
    )
    rows = {r.plot_id: r for r in alerts.hourly_metrics(df).collect()}
    assert rows["unknown"].avg_ndvi == 0.2 and rows["unknown"].n_ndvi == 1
    assert [r.plot_id for r in alerts.plot_alerts(df).collect()] == ["unknown"]


def test_salted_equals_plain(spark):
    df = event_rows(spark, *[
        {"event_uuid": f"e{i}", "event_type": C.SOIL, "moisture_pct": 20.0 + i % 7 / 10,
         "plot_id": f"P{i % 3}", "ts": at(i)} for i in range(200)
    ])
    plain = sorted(alerts.hourly_metrics(df).collect())
    assert sorted(alerts.salted_metrics(df, 5).collect()) == plain


def test_means_are_not_rounded(spark):
    rows = [("a", 0.29996, 25.0, 38.0), ("b", 0.3, 24.99999, 38.00001), ("c", 0.1 + 0.2, None, None)]
    found = alerts.plot_alerts(event_rows(spark, *[
        {"event_uuid": str(i), "plot_id": plot, "event_type": kind, reading: value}
        for i, (plot, *values) in enumerate(rows)
        for kind, reading, value in zip(alerts.SOURCES, ("ndvi", "temperature_c", "moisture_pct"),
                                        (values[0], values[2], values[1]))]))
    assert {(r.plot_id, r.alert_type) for r in found.collect()} == {
        ("a", C.NDVI_ALERT[0]), ("b", C.MOISTURE_ALERT[0]), ("b", C.HEAT_ALERT[0])}
