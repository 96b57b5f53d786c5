"""Small hand-made inputs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from furrow import contracts as C

EVENT_DDL = (
    "event_uuid string, event_type string, ts timestamp, plot_id string, crop string, "
    "ndvi double, moisture_pct double, temperature_c double, price_per_quintal_inr double, "
    "market_location string"
)
NAMES = [c.split()[0] for c in EVENT_DDL.split(", ")]
T0 = dt.datetime(2024, 1, 1, 10)


def at(minutes: float = 0, hours: float = 0, micros: int = 0) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes, hours=hours, microseconds=micros)


def event_rows(spark: SparkSession, *rows: dict) -> DataFrame:
    filled = [
        tuple({"event_uuid": str(i), "event_type": C.WEATHER, "ts": T0, "plot_id": "WB_123_45",
               **row}.get(n) for n in NAMES)
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(filled, EVENT_DDL)


MESSAGE = {
    "alert_id": "first-alert", "plot_id": "WB_123_45", "farmer_id": "FARM-7",
    "alert_type": "low_soil_moisture", "severity": "critical",
    "message_en": "Roots find no water", "message_local": None, "language": "en",
    "channel": "whatsapp", "ts": T0,
}
MESSAGE_DDL = (
    "alert_id string, plot_id string, farmer_id string, alert_type string, severity string, "
    "message_en string, message_local string, language string, channel string, ts timestamp"
)


def message_rows(spark: SparkSession, *rows: dict) -> DataFrame:
    return spark.createDataFrame(
        [tuple({**MESSAGE, **row}.values()) for row in rows], MESSAGE_DDL)


def contact_rows(spark: SparkSession, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), C.CONTACT_DDL)
