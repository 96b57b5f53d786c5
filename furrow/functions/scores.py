"""Scores and ratings of a plot's current readings (own definitions, see contracts)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from furrow import contracts as C


def _clamped(value: Column) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def health_score(ndvi: Column, moisture: Column, air_temp: Column) -> Column:
    """Mean of the components that have a reading, null when none has."""
    lo, span = C.HEALTH_NDVI
    green = _clamped((ndvi - F.lit(lo)) / F.lit(span))
    lo, span = C.HEALTH_MOISTURE
    wet = _clamped((moisture - F.lit(lo)) / F.lit(span))
    hi, span = C.HEALTH_HEAT
    cool = _clamped((F.lit(hi) - air_temp) / F.lit(span))
    parts = [green, wet, cool]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0.0)))
    seen = sum((p.isNotNull().cast("int") for p in parts[1:]), parts[0].isNotNull().cast("int"))
    return F.when(seen > 0, total / seen)


def soil_rating(columns: dict[str, Column]) -> Column:
    good = F.lit(0)
    for name, (low, high) in C.SOIL_GOOD.items():
        ok = F.lit(True)
        if low is not None:
            ok = ok & (columns[name] >= low)
        if high is not None:
            ok = ok & (columns[name] <= high)
        good = good + F.when(ok, 1).otherwise(0)
    return F.when(good >= 5, "good").when(good >= 3, "fair").otherwise("poor")


def forecast_text(temp_max: Column, rain_probability: Column) -> Column:
    return F.format_string(
        "Max %.1f°C, %d%% chance of rain",
        temp_max, F.rint(rain_probability * 100).cast("int"),
    )
