"""Reads and writes behind the plot and alert views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import scores, text


def plot_lookup(plots: DataFrame, plot_id: str | Column) -> DataFrame:
    """The plot with this id; no row when there is none."""
    return plots.filter(F.col("plot_id") == plot_id)


def newest_rows(events: DataFrame, *event_types: str) -> DataFrame:
    """The rows of each plot and event type at their newest time: one, or those that share it.

    The time is a hash aggregate, so raw rows are neither sorted nor gathered; only the rows at it
    go on.
    """
    rows = events.filter(F.col("event_type").isin(*event_types) & F.col("plot_id").isNotNull())
    times = rows.groupBy("plot_id", "event_type").agg(F.max("ts").alias("ts"))
    return rows.join(times, ["plot_id", "event_type", "ts"])


def latest_per_plot(events: DataFrame, event_type: str, readings: list[str]) -> DataFrame:
    """Newest event of one type per plot; of several at one time the one with the greatest id. The
    event counts as a whole, including readings it lacks."""
    newest = newest_rows(events, event_type).groupBy("plot_id").agg(
        F.max_by(F.struct("ts", *readings), "event_uuid").alias("r"))
    return newest.select("plot_id", "r.*")


def latest_weather(events: DataFrame) -> DataFrame:
    now = latest_per_plot(events, C.WEATHER, [
        "temperature_c", "humidity_pct", "precipitation_mm", "temp_max", "rain_probability"])
    return now.select(
        "plot_id", "ts", "temperature_c", "humidity_pct", "precipitation_mm",
        scores.forecast_text(F.col("temp_max"), F.col("rain_probability")).alias("forecast_3d"),
    )


def latest_soil(events: DataFrame) -> DataFrame:
    readings = list(C.SOIL_GOOD)
    now = latest_per_plot(events, C.SOIL, readings)
    return now.withColumn("health_rating", scores.soil_rating({c: F.col(c) for c in readings}))


def alert_lists(alerts: DataFrame) -> DataFrame:
    """Per plot its alerts in time order and the advice they call for.

    A list holds at most three alerts per hour of the input's time span, whatever the number of
    events behind them.
    """
    return alerts.groupBy("plot_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("window_end").alias("ts"), F.col("alert_type").alias("type"), "severity",
        ))).alias("alerts"),
        F.array_sort(F.collect_set(text.lookup(F.col("alert_type"), C.RECOMMENDATIONS)))
        .alias("recommendations"),
    )


def plot_status(plots: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Status of every plot with at least one reading.

    All inputs are reduced to one row per plot first; the joins then meet on equal keys.
    """
    readings = (
        newest_rows(events, C.SATELLITE, C.WEATHER, C.SOIL).groupBy("plot_id")
        .agg(
            _newest(C.SATELLITE, "ndvi"), _newest(C.SOIL, "moisture_pct"),
            _newest(C.WEATHER, "temperature_c"), F.max("ts").alias("last_updated"),
        )
    )
    empty_alerts = F.array().cast(
        "array<struct<ts:timestamp,type:string,severity:string>>")
    return (
        plots.select("plot_id", "crop_type")
        .join(readings, "plot_id")
        .join(alert_lists(alerts), "plot_id", "left")
        .select(
            "plot_id", "crop_type",
            scores.health_score(F.col("ndvi"), F.col("moisture_pct"), F.col("temperature_c"))
            .alias("health_score"),
            "last_updated",
            F.coalesce("alerts", empty_alerts).alias("alerts"),
            F.coalesce("recommendations", F.array().cast("array<string>"))
            .alias("recommendations"),
        )
    )


def _newest(event_type: str, reading: str) -> Column:
    of_type = F.col("event_type") == event_type
    return F.max_by(
        F.when(of_type, F.col(reading)), F.when(of_type, F.struct("ts", "event_uuid"))
    ).alias(reading)


def recent_alerts(alerts: DataFrame, plot_id: str | None = None, limit: int = 10) -> DataFrame:
    """The newest alerts overall or of one plot."""
    if plot_id is not None:
        alerts = alerts.filter(F.col("plot_id") == plot_id)
    return alerts.orderBy(F.desc("timestamp"), "alert_id").limit(limit)


def recent_alerts_per_plot(alerts: DataFrame, n: int = 3) -> DataFrame:
    """The newest n alerts of each plot; the rank limit is applied before the shuffle too."""
    order = W.partitionBy("plot_id").orderBy(F.desc("timestamp"), "alert_id")
    return alerts.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= n)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with the flag set where the log holds their id."""
    done = acks.select("alert_id").distinct().withColumn("_seen", F.lit(True))
    return (
        alerts.join(done, "alert_id", "left")
        .withColumn("acknowledged", F.coalesce("_seen", F.lit(False))).drop("_seen")
    )


def plots_with_open_alerts(plots: DataFrame, alerts: DataFrame) -> DataFrame:
    """Plots with an alert nobody acknowledged; plots are reduced to distinct ids before the
    join, so a plot with many alerts weighs no more than another."""
    open_plots = alerts.filter(~F.col("acknowledged")).select("plot_id").distinct()
    return plots.join(open_plots, "plot_id", "left_semi")


def create_alerts(requests: DataFrame) -> DataFrame:
    """Alert rows for a batch of requests (plot_id, alert_type, severity, message, ts)."""
    return requests.select(
        text.alert_id(F.col("plot_id"), F.col("alert_type"), F.col("ts"), F.col("message"))
        .alias("alert_id"),
        text.length_id("alert", F.col("plot_id"), F.col("message")).alias("legacy_id"),
        "plot_id", "alert_type",
        F.coalesce("severity", F.lit(C.DEFAULT_SEVERITY)).alias("severity"), "message",
        F.col("ts").alias("timestamp"), F.lit(False).alias("acknowledged"),
    )


def manual_reports(reports: DataFrame) -> DataFrame:
    """Alert rows for reports entered by hand (plot_id, report_type, description, severity, ts)."""
    plot, kind, words = F.col("plot_id"), F.col("report_type"), F.col("description")
    return reports.select(
        text.alert_id(plot, kind, F.col("ts"), words).alias("alert_id"),
        text.length_id("manual", plot, words).alias("legacy_id"),
        "plot_id", kind.alias("alert_type"),
        F.coalesce("severity", F.lit(C.DEFAULT_SEVERITY)).alias("severity"),
        words.alias("message"), F.col("ts").alias("timestamp"),
        F.lit(False).alias("acknowledged"),
    )
