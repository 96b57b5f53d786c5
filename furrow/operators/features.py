"""Joined and windowed features per plot and crop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import exact, spread


def _hourly(events: DataFrame, event_type: str, readings: dict[str, str]) -> DataFrame:
    return (
        events.filter((F.col("event_type") == event_type) & F.col("plot_id").isNotNull())
        .groupBy("plot_id", F.date_trunc("hour", "ts").alias("hour"))
        .agg(*[exact.mean(F.col(r)).alias(name) for name, r in readings.items()])
    )


def windowed_join(events: DataFrame, plots: DataFrame) -> DataFrame:
    """Weather, vegetation and market side by side per plot and hour.

    Every side is reduced to one row per key before it is joined, and all joins are full outer: the
    market price is that of the plot's crop on the day, and a crop's day without any plot's hour
    keeps its price.
    """
    weather = _hourly(events, C.WEATHER, {"air_temp": "temperature_c", "rain": "precipitation_mm"})
    green = _hourly(events, C.SATELLITE, {"ndvi": "ndvi"})
    prices = (
        events.filter(F.col("event_type") == C.MARKET)
        .groupBy(F.col("crop").alias("crop_type"), F.to_date("ts").alias("day"))
        .agg(exact.mean(F.col("price_per_quintal_inr")).alias("price"))
    )
    crops = plots.select("plot_id", "crop_type")
    both = weather.join(green, ["plot_id", "hour"], "full_outer").join(crops, "plot_id", "left")
    return (
        both.withColumn("day", F.to_date("hour"))
        .join(prices, ["crop_type", "day"], "full_outer")
        .select("plot_id", "crop_type", F.col("day").cast("string").alias("day"), "hour", "air_temp",
                "rain", "ndvi", "price")
    )


def asof_weather(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each satellite pass with the last weather reading of its plot at or before it.

    No inequality join: both kinds of row lie on one time line per plot, cut into ranges of (plot,
    time, kind, id); the last reading inside the range wins, else the one carried over from earlier
    ranges. `ranges` fixes their number, which otherwise follows the size of the table.
    """
    both = events.filter(
        F.col("event_type").isin(C.SATELLITE, C.WEATHER) & F.col("plot_id").isNotNull()
    ).select(
        "plot_id", "ts", "event_uuid", "ndvi",
        # at equal times the reading comes before the pass
        F.when(F.col("event_type") == C.WEATHER, 0).otherwise(1).alias("side"),
        F.struct(F.col("ts").alias("at"), F.col("temperature_c").alias("temp")).alias("reading"),
    )
    keys, weather = ["plot_id"], F.col("side") == 0
    rows = spread.with_carry(
        spread.ranged(both, ["plot_id", "ts", "side", "event_uuid"], ranges), keys,
        F.col("reading"), weather, F.struct("ts", "event_uuid"), "carry")
    order = (
        W.partitionBy(*keys, spread.RANGE).orderBy("ts", "side", "event_uuid")
        .rowsBetween(W.unboundedPreceding, 0)
    )
    found = F.coalesce("seen", "carry")
    return rows.withColumn(
        "seen", F.last(F.when(weather, F.col("reading")), ignorenulls=True).over(order)
    ).filter(~weather).select(
        "event_uuid", "plot_id", "ts", "ndvi",
        found["at"].alias("weather_ts"), found["temp"].alias("temperature_c"),
    )


def price_change(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each quote with the one before it in its crop and market, and the change in percent.

    There are few (crop, market) pairs and any number of quotes, so the time line is cut into
    ranges of (crop, market, time, id), also within one instant.
    """
    quotes = events.filter(F.col("event_type") == C.MARKET).select(
        "event_uuid", F.coalesce("crop", F.lit("unknown")).alias("crop"),
        F.coalesce("market_location", F.lit("unknown")).alias("market_location"), "ts",
        # a quote without a price is a quote all the same
        F.struct(F.col("price_per_quintal_inr").alias("price")).alias("quote"))
    keys = ["crop", "market_location"]
    rows = spread.with_carry(
        spread.ranged(quotes, [*keys, "ts", "event_uuid"], ranges), keys,
        F.col("quote"), F.lit(True), F.struct("ts", "event_uuid"), "carry")
    order = W.partitionBy(*keys, spread.RANGE).orderBy("ts", "event_uuid")
    before, price = F.coalesce("before", "carry")["price"], F.col("quote.price")
    return rows.withColumn("before", F.lag("quote").over(order)).select(
        "event_uuid", "crop", "market_location", "ts", price.alias("price"),
        before.alias("previous_price"),
        F.when(before != 0, (price - before) / before * 100.0).alias("change_pct"),
    )


def market_price_per_plot(plots: DataFrame, events: DataFrame) -> DataFrame:
    """Newest price of each plot's crop; how the join runs is decided by sizes at run time."""
    prices = (
        events.filter(F.col("event_type") == C.MARKET).groupBy("crop")
        .agg(F.max_by(
            F.struct(F.col("price_per_quintal_inr").alias("price"), "market_location",
                     F.col("ts").alias("price_ts")),
            F.struct("ts", "event_uuid")).alias("p"))
        .select(F.col("crop").alias("crop_type"), "p.*")
    )
    return plots.select("plot_id", "crop_type").join(prices, "crop_type", "left")


def daily_features(events: DataFrame) -> DataFrame:
    """One feature row per plot and day, all in one aggregation."""
    rows = events.filter(
        F.col("event_type").isin(C.SATELLITE, C.WEATHER, C.SOIL) & F.col("plot_id").isNotNull())
    air = F.when(F.col("event_type") == C.WEATHER, F.col("temperature_c"))

    def three(name: str, reading):
        return [exact.mean(reading).alias(f"avg_{name}"), F.min(reading).alias(f"min_{name}"),
                F.max(reading).alias(f"max_{name}")]

    return rows.groupBy("plot_id", F.to_date("ts").cast("string").alias("day")).agg(
        *three("ndvi", F.col("ndvi")),
        *three("moisture", F.col("moisture_pct")),
        *three("air_temp", air),
        exact.value_of(F.sum(exact.units(F.col("precipitation_mm")))).alias("rain_mm"),
        F.count(F.lit(1)).alias("n_readings"),
    )


def rolling_mean(events: DataFrame, event_type: str = C.WEATHER, reading: str = "temperature_c",
                 hours: int = 24) -> DataFrame:
    """Mean of a reading over the hours up to each second at which a plot reported.

    Readings are reduced to sums per plot and second. A sum enters at its second and leaves again
    when the span has passed, so the mean is a running total, which costs the same per row however
    many rows the span holds. Time is cut into stretches as long as the span: a sum counts in the
    stretch it lies in and in the next one, and no window sees more than two stretches of a plot.
    """
    span = hours * 3600
    per_second = (
        events.filter((F.col("event_type") == event_type) & F.col("plot_id").isNotNull())
        .groupBy("plot_id", F.unix_seconds(F.date_trunc("second", "ts")).alias("second"))
        .agg(F.sum(exact.units(F.col(reading))).alias("total"),
             F.count(exact.units(F.col(reading))).alias("n"))
    )
    home = F.floor(F.col("second") / F.lit(span)).cast("bigint")
    # total is null where a second has rows but no reading
    total, n = F.coalesce("total", F.lit(0)), F.col("n")

    def change(stretch, at, t, c, shown: bool):
        return F.struct(stretch.alias("stretch"), at.alias("at"), t.alias("t"), c.alias("c"),
                        F.lit(shown).alias("shown"))

    changes = per_second.select("plot_id", F.inline(F.array(
        change(home, F.col("second"), total, n, True),
        change(home + 1, F.col("second"), total, n, False),
        change(home + 1, F.col("second") + (span + 1), -total, -n, False),
    )))
    so_far = W.partitionBy("plot_id", "stretch").orderBy("at").rangeBetween(
        W.unboundedPreceding, W.currentRow)
    return (
        changes.withColumns({"w_total": F.sum("t").over(so_far), "w_n": F.sum("c").over(so_far)})
        .filter("shown")
        .select("plot_id", F.timestamp_seconds("at").alias("ts"),
                exact.mean_of(F.col("w_total"), F.col("w_n")).alias("rolling_mean"),
                F.col("w_n").alias("n_readings"))
    )
