"""Hourly metrics per plot and the threshold alerts drawn from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import exact

SOURCES = [C.SATELLITE, C.WEATHER, C.SOIL]
# output name -> reading
METRICS = {"ndvi": "ndvi", "moisture": "moisture_pct", "temp": "temperature_c"}


def _grouped(events: DataFrame, *extra: Column):
    return events.groupBy(
        F.coalesce("plot_id", F.lit(C.UNKNOWN_PLOT)).alias("plot_id"),
        F.window("ts", C.WINDOW).alias("w"),
        *extra,
    )


def _sums() -> list[Column]:
    out = []
    for name, reading in METRICS.items():
        u = exact.units(F.col(reading))
        out += [F.sum(u).alias(f"sum_{name}"), F.count(u).alias(f"n_{name}")]
    return out


def _flat(sums: DataFrame) -> DataFrame:
    return sums.select(
        "plot_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        *[F.col(f"{part}_{m}") for m in METRICS for part in ("sum", "n")])


def hourly_sums(events: DataFrame) -> DataFrame:
    """Sums and counts of the three readings per plot and hour: what can still be added to."""
    return _flat(_grouped(events).agg(*_sums()))


def added(sums: DataFrame) -> DataFrame:
    """Sums of several batches as one row per plot and hour, with the last batch's id."""
    return sums.groupBy("plot_id", "window_start", "window_end").agg(
        *[F.sum(f"{part}_{m}").cast(kind).alias(f"{part}_{m}")
          for m in METRICS for part, kind in (("sum", exact.EXACT), ("n", "bigint"))],
        F.max("batch_id").alias("batch_id"))


def averages(sums: DataFrame) -> DataFrame:
    """Sums as means."""
    return sums.select(
        "plot_id", "window_start", "window_end", *[F.col(f"n_{m}") for m in METRICS],
        *[exact.mean_of(F.col(f"sum_{m}"), F.col(f"n_{m}")).alias(f"avg_{m}") for m in METRICS],
    )


def hourly_metrics(events: DataFrame) -> DataFrame:
    """Means and counts of the three readings per plot and hour, in one aggregation.

    Works on a batch and on a watermarked stream. Air and soil temperatures share one column and
    so one mean. Partial sums are formed before the shuffle, so a busy plot sends one row per
    hour and task.
    """
    return averages(hourly_sums(events))


def salted_metrics(events: DataFrame, salts: int = 16) -> DataFrame:
    """The same table by way of a compound key, for inputs whose partial sums do not shrink
    (many plots per task): the first stage spreads a plot-hour over `salts` reducers."""
    salt = F.pmod(F.xxhash64("event_uuid"), F.lit(salts)).alias("salt")
    first = _grouped(events, salt).agg(*_sums())
    merged = first.groupBy("plot_id", "w").agg(
        *[F.sum(f"{part}_{m}").alias(f"{part}_{m}") for m in METRICS for part in ("sum", "n")]
    )
    return averages(_flat(merged))


#: A plot-hour is hot with this share of all rows: no more than 100 can be.
HOT_SHARE = 0.01


def _hour_key() -> Column:
    """One per plot and hour; null without a time. (Unlike `window`, it keeps rows without one.)"""
    return F.concat(F.floor(F.unix_seconds("ts") / 3600).cast("string"), F.lit("@"),
                    F.coalesce("plot_id", F.lit(C.UNKNOWN_PLOT)))


def hot_hours(events: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """hot (hour@plot), rows: plot-hours with at least that share of all rows, 1 / share at most.

    From a frequent-items summary that tasks build and merge, so nothing is shuffled by key; its
    counts are off by at most some hundredth of the share.
    """
    most = math.floor(1 / share)
    summary = events.select(_hour_key().alias("key")).filter("key IS NOT NULL").agg(
        F.expr(f"approx_top_k(key, {most}, {min(400 * most, 1_000_000)})").alias("top"),
        F.count(F.lit(1)).alias("total"))
    return summary.select("total", F.inline("top")).filter(F.col("count") >= F.col("total") * share) \
        .select(F.col("item").alias("hot"), F.col("count").alias("rows"))


def split_hot(events: DataFrame, share: float = HOT_SHARE) -> tuple[DataFrame, DataFrame]:
    """Rows of hot plot-hours, and all others. The list of hot ones is short by its definition, so
    it is broadcast."""
    listed = F.broadcast(hot_hours(events, share).select("hot"))
    keyed = events.withColumn("_key", F.coalesce(_hour_key(), F.lit("")))
    same = F.col("_key") == F.col("hot")
    return tuple(keyed.join(listed, same, how).drop("_key") for how in ("left_semi", "left_anti"))


def hot_salted_metrics(events: DataFrame, salts: int = 16, share: float = HOT_SHARE) -> DataFrame:
    """The same table with salts for hot plot-hours only; all others take one shuffle."""
    hot, others = split_hot(events, share)
    return salted_metrics(hot, salts).unionByName(hourly_metrics(others))


def _alert(condition: Column, rule: tuple[str, str, float], message: Column) -> Column:
    return F.when(condition, F.struct(
        F.lit(rule[0]).alias("alert_type"), F.lit(rule[1]).alias("severity"),
        message.alias("message"),
    ))


def raised(metrics: DataFrame) -> DataFrame:
    """Per plot-hour the list of its alerts, empty where there are none; a mean equal to its
    threshold raises none."""
    ndvi, moisture, temp = F.col("avg_ndvi"), F.col("avg_moisture"), F.col("avg_temp")
    found = F.array_compact(F.array(
        _alert(ndvi < C.NDVI_ALERT[2], C.NDVI_ALERT, F.format_string(C.NDVI_MESSAGE, ndvi)),
        _alert(moisture < C.MOISTURE_ALERT[2], C.MOISTURE_ALERT,
               F.format_string(C.MOISTURE_MESSAGE, moisture)),
        _alert(temp > C.HEAT_ALERT[2], C.HEAT_ALERT, F.format_string(C.HEAT_MESSAGE, temp)),
    ))
    return metrics.select(
        F.col("plot_id").cast("string").alias("plot_id"), "window_end", found.alias("raised"))


def alerts_from(metrics: DataFrame) -> DataFrame:
    """Zero to three alert rows per plot-hour."""
    return raised(metrics).select("plot_id", "window_end", F.inline("raised"))


def plot_alerts(events: DataFrame) -> DataFrame:
    chosen = events.filter(F.col("event_type").isin(SOURCES))
    return alerts_from(hourly_metrics(chosen))


def air_heat_alerts(events: DataFrame) -> DataFrame:
    """Heat alerts from air temperatures only, without the soil readings that damp the mean."""
    air = events.filter(F.col("event_type") == C.WEATHER)
    return alerts_from(hourly_metrics(air)).filter(F.col("alert_type") == C.HEAT_ALERT[0])
