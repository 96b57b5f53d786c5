"""Quantile sketches, typed contract drift and salts for hot plot-hours, on planted rows."""

from __future__ import annotations

import json

import pytest
from helpers import at, event_rows
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.operators import alerts, metrics, quality


def _latencies(spark, n=20_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("api")).alias("service"),
        (F.lit(at()).cast("timestamp") + F.make_interval(secs=F.col("id") % 7200)).alias("ts"),
        F.when(F.col("id") % 11 == 0, None).otherwise((F.col("id") * 7919 % n).cast("double"))
        .alias("ms"))


@pytest.mark.parametrize("span", ["5 minutes", "1 hour", "1 day"])
def test_merged_sketches_keep_their_rank_error(spark, span):
    rows, keys = _latencies(spark), ["service"]
    merged = metrics.rolled_up(metrics.latency_sketches(rows, F.col("ms"), keys), keys, "5 minutes")
    merged = metrics.rolled_up(merged, keys, span)
    report = metrics.sketch_report(merged, keys, C.API_P95_LIMIT_MS)
    got = metrics.sketch_check(rows, F.col("ms"), report, keys, span).collect()
    assert all(r["within"] for r in got)
    assert sum(r["n"] for r in got) == rows.filter("ms IS NOT NULL").count()
    assert sum(r["n"] for r in report.collect()) == sum(r["n"] for r in got)


def test_wrong_percentiles_are_found_out(spark):
    rows, keys = _latencies(spark), ["service"]
    report = metrics.sketch_report(metrics.latency_sketches(rows, F.col("ms"), keys), keys, 1.0)
    report = metrics.sketch_report(
        metrics.rolled_up(metrics.latency_sketches(rows, F.col("ms"), keys), keys, "1 day"), keys, 1.0)
    off = report.withColumn("quantile", F.col("quantile") * 0.9)
    assert not any(r["within"] for r in metrics.sketch_check(rows, F.col("ms"), off, keys, "1 day").collect())


@pytest.mark.parametrize(("limit", "alarm"), [
    (C.API_P95_LIMIT_MS, "over"), (C.LATENCY_P95_LIMIT_MS, "under"), (950.0, "open")])
def test_alarm_says_when_the_sketch_cannot_tell(spark, limit, alarm):
    rows = spark.range(1, 1001).select(F.lit("x").alias("service"), F.lit(at()).cast("timestamp").alias("ts"),
                                       F.col("id").cast("double").alias("ms"))
    report = metrics.sketch_report(metrics.latency_sketches(rows, F.col("ms"), ["service"]), ["service"], limit)
    assert [r["alarm"] for r in report.collect()] == [alarm]


def test_sketches_of_nothing(spark):
    rows = _latencies(spark).limit(0)
    assert metrics.latency_sketches(rows, F.col("ms"), ["service"]).count() == 0


def _drift(spark, *texts):
    rows = quality.typed_drift(spark.createDataFrame([(t,) for t in texts], "value string")).collect()
    return {(r["event_type"], r["path"], r["kind"]): (r["n"], r["state"], r["change"]) for r in rows}


def _event(kind, **data):
    return json.dumps({"event_type": kind, "data": data})


def test_planted_changes_of_kind_are_found(spark):
    got = _drift(
        spark,
        _event(C.WEATHER, temperature_c=20.5, forecast_3d={"temp_max": 31, "rain_probability": 0.5}),
        _event(C.WEATHER, temperature_c="20.5", forecast_3d={"temp_max": "31", "wind": {"gust": 9}}),
        _event(C.WEATHER, temperature_c=None, forecast_3d=[{"temp_max": 31}, {"temp_max": 30}]),
        _event("drone_pass", height=3), _event(C.WEATHER), json.dumps({"data": {"ph": 7}}),
        json.dumps({"event_type": C.SOIL}), "{bad", None)
    weather = lambda path, kind: got[(C.WEATHER, path, kind)]
    assert weather("temperature_c", "number") == (1, "known", "none")
    assert weather("temperature_c", "string") == (1, "changed", "breaking")
    assert weather("temperature_c", "null") == (1, "null", "compatible")
    assert weather("forecast_3d", "object") == (2, "known", "none")
    assert weather("forecast_3d", "array") == (1, "changed", "breaking")
    assert weather("forecast_3d.temp_max", "string") == (1, "changed", "breaking")
    assert weather("forecast_3d.rain_probability", "number") == (1, "known", "none")
    assert weather("forecast_3d.wind", "object") == (1, "unknown", "compatible")
    assert weather("forecast_3d.wind.gust", "number") == (1, "unknown", "compatible")
    assert weather("forecast_3d[]", "object") == (2, "unknown", "compatible")
    assert weather("forecast_3d[].temp_max", "number") == (2, "unknown", "compatible")
    assert weather("humidity_pct", None) == (0, "missing", "breaking")
    assert got[("drone_pass", "height", "number")] == (1, "unknown", "compatible")
    assert got[(None, None, "untyped")] == (1, "untyped", "breaking")
    assert got[(None, None, "undecodable")] == (2, "undecodable", "breaking")


def test_contract_without_records_is_missing(spark):
    assert {state for _, state, _ in _drift(spark).values()} == {"missing"}


def test_salts_for_hot_hours_only(spark):
    busy = [{"plot_id": "hot", "ts": at(minutes=i % 60), "ndvi": i / 1000} for i in range(600)]
    calm = [{"plot_id": f"p{i % 200}", "ts": at(hours=i % 5), "moisture_pct": float(i)} for i in range(400)]
    unknown = [{"plot_id": None, "ts": at(), "temperature_c": 30.0}] * 50 + [{"ts": None}]
    rows = event_rows(spark, *busy, *calm, *unknown)
    hot, others = alerts.split_hot(rows, 0.04)
    assert {r["plot_id"] for r in hot.collect()} == {"hot", None}
    assert hot.count() == 650 and others.count() == 401
    assert sorted(alerts.hot_salted_metrics(rows, 5, 0.04).collect()) == \
        sorted(alerts.hourly_metrics(rows).collect())


def test_no_hot_hours_in_nothing(spark):
    empty = event_rows(spark, {}).limit(0)
    assert alerts.hot_hours(empty).count() == 0
    assert alerts.hot_salted_metrics(empty).count() == 0
