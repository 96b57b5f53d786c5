"""Farm events read out of the general test tables.

`events` becomes the event stream (its five types map to ours, readings follow from the number k
in `props`), `customer` with `nation` and `region` becomes the plot and contact tables. Every row of
a table is used; the defects some checks look for (bad domains, undecodable text, late arrival) are
also functions of k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import text
from furrow.operators import notify

RAW_TYPES = {
    "view": C.SATELLITE,
    "click": C.WEATHER,
    "error": C.SOIL,
    "signup": C.REPORT,
    "purchase": C.MARKET,
}
CONTACT_CHANNELS = ["whatsapp", "sms", "voice_call", "sns"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark: SparkSession, sf_dir: str, name: str, **options) -> DataFrame:
    """The same table as a file stream; the one-letter class makes the path a pattern, which the
    file source accepts for a single file as well as for a folder of parts."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).options(**options).parquet(
        f"{sf_dir}/{name}.parque[t]"
    )


def _pick(values: list[str], index: str) -> str:
    items = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({items}), cast({index} % {len(values)} as int) + 1)"


def _scaled(base: int, step: int, scale: int) -> str:
    return f"cast({base} + k * {step} as double) / {float(scale)}D"


# event type -> column -> SQL over k, plot_id, event_uuid and measure
_COLUMNS = {
    C.SATELLITE: {
        "ndvi": _scaled(200, 6, 1000),
        "evi": _scaled(150, 4, 1000),
        "cloud_cover": "cast(k % 41 as double) / 100.0D",
    },
    C.WEATHER: {
        "temperature_c": _scaled(200, 2, 10),
        "humidity_pct": _scaled(400, 5, 10),
        "precipitation_mm": _scaled(0, 50, 100),
        "wind_speed_kmh": _scaled(50, 2, 10),
        "temp_max": _scaled(250, 1, 10),
        "rain_probability": _scaled(0, 1, 100),
    },
    C.SOIL: {
        "temperature_c": _scaled(220, 1, 10),
        "moisture_pct": _scaled(200, 4, 10),
        "ph": _scaled(550, 2, 100),
        "nitrogen_ppm": _scaled(2000, 20, 10),
        "phosphorus_ppm": _scaled(1500, 25, 100),
        "potassium_ppm": _scaled(1500, 15, 10),
        "battery_level": _scaled(600, 4, 10),
        "soil_type": _pick(C.SOIL_TYPES, "k"),
    },
    C.REPORT: {
        "crop": _pick(C.CROPS, "k"),
        "report_type": _pick(C.REPORT_TYPES, "k"),
        "description":
            f"concat('Observed ', {_pick(C.PESTS, 'k')}, ' on ', {_pick(C.CROPS, 'k')})",
        "language": _pick(C.LANGUAGES, "k"),
        "severity": _pick(C.SEVERITIES, "k"),
        "image_url":
            "if(k % 2 = 0, concat('s3://field-images/', plot_id, '/', event_uuid, '.jpg'), null)",
        "farmer_id": "plot_id",
        "channel": _pick(C.CHANNELS, "k"),
        "lat": _scaled(200, 1, 10),
        "lon": _scaled(800, 1, 10),
    },
    C.MARKET: {
        "crop": _pick(C.CROPS, "k"),
        "price_per_quintal_inr": "measure",
        "arrival_quantity_mt": _scaled(500, 45, 10),
        "price_change_pct": _scaled(-500, 10, 100),
        "market_location": _pick(C.MARKETS, "k"),
    },
}


def as_events(raw: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Typed, flat event rows; columns of other event types are null.

    The wanted types are filtered under their stored names, so the filter reaches the scan.
    """
    if types:
        raw = raw.filter(F.col("event_type").isin([r for r, t in RAW_TYPES.items() if t in types]))
    kind = " ".join(f"when '{r}' then '{t}'" for r, t in RAW_TYPES.items())
    base = raw.selectExpr(
        "cast(event_id as string) as event_uuid",
        f"case event_type {kind} end as event_type",
        "cast(ts as timestamp) as ts",
        "if(event_type <> 'purchase', cast(user_id as string), null) as plot_id",
        "value as measure",
        "cast(get_json_object(props, '$.k') as int) as k",
    )
    cases: dict[str, list[str]] = {}
    for of_type, columns in _COLUMNS.items():
        for name, value in columns.items():
            cases.setdefault(name, []).append(f"when '{of_type}' then {value}")
    return base.selectExpr(
        "event_uuid", "event_type", "ts", "plot_id", "k", "measure",
        *[f"case event_type {' '.join(whens)} end as {name}" for name, whens in cases.items()])


def events(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"), types)


def stream_events(spark: SparkSession, sf_dir: str, types: list[str] | None = None,
                  **options) -> DataFrame:
    return as_events(stream_table(spark, sf_dir, "events", **options), types)


def flawed(df: DataFrame) -> DataFrame:
    """Rows with the defects quality rules look for: ndvi out of range, an unknown severity, no
    plot key."""
    return df.withColumns({
        "ndvi": F.when(F.col("k") == 37, F.col("ndvi") + 10.0).otherwise(F.col("ndvi")),
        "moisture_pct": F.when(F.col("k") == 38, -F.col("moisture_pct"))
                         .otherwise(F.col("moisture_pct")),
        "severity": F.when((F.col("k") >= 43) & (F.col("k") < 46) & F.col("severity").isNotNull(),
                           "urgent").otherwise(F.col("severity")),
        "plot_id": F.when(F.col("k") >= 2, F.col("plot_id")),
    })


def redelivered(df: DataFrame) -> DataFrame:
    """Every row twice: as first sent, and once more a minute later with a newer measure."""
    again = df.withColumns({
        "ts": F.col("ts") + F.expr("interval 1 minute"), "measure": F.col("measure") + 1.0,
    })
    return df.unionByName(again)


def payloads(df: DataFrame) -> DataFrame:
    """Topic records as they travel: key, JSON text, topic. Some texts cannot be decoded."""
    data = F.struct(
        "ndvi", "evi", "cloud_cover", "temperature_c", "humidity_pct", "precipitation_mm",
        "wind_speed_kmh",
        F.when(F.col("temp_max").isNotNull(),
               F.struct("temp_max", "rain_probability")).alias("forecast_3d"),
        "moisture_pct", "ph", "nitrogen_ppm", "phosphorus_ppm", "potassium_ppm",
        "report_type", "description", "language", "severity", "image_url",
        "price_per_quintal_inr", "arrival_quantity_mt", "price_change_pct", "market_location",
        # a key the contract does not know
        F.when((F.col("event_type") == C.SOIL) & (F.col("k") < 10),
               F.lit(1)).alias("firmware"),
    )
    metadata = F.struct(
        "battery_level", "soil_type", "farmer_id", "channel",
        F.when(F.col("lat").isNotNull(), F.struct("lat", "lon")).alias("location"),
    )
    body = F.to_json(F.struct(
        "event_uuid", "event_type",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "plot_id", F.when(F.col("event_type") == C.MARKET, F.col("crop")).alias("crop"),
        data.alias("data"), metadata.alias("metadata"),
    ))
    return df.select(
        text.topic_of(F.col("event_type")).alias("topic"),
        F.coalesce("plot_id", "crop").alias("key"),
        F.when(F.col("k") == 29, "not json").when(F.col("k") == 30, "{bad")
         .otherwise(body).alias("value"),
        F.col("ts").alias("received"),
        F.col("event_uuid").alias("record_id"),
    )


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    owner = F.col("c_custkey").cast("string")
    return (
        customer
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            owner.alias("plot_id"),
            F.col("r_name").alias("state"),
            F.col("n_name").alias("district"),
            F.expr(_pick(C.CROPS, "c_custkey")).alias("crop_type"),
            (F.abs("c_acctbal") / 1000.0).alias("area_hectares"),
            F.col("c_name").alias("farmer_name"),
            owner.alias("farmer_id"),
        )
    )


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.cast("string").alias("farmer_id"),
        F.concat(F.lit("+91"), F.lpad(key.cast("string"), 10, "0")).alias("phone"),
        F.expr(_pick(C.LANGUAGES, "c_custkey")).alias("preferred_language"),
        F.expr(_pick(CONTACT_CHANNELS, "c_custkey")).alias("preferred_channel"),
    )


def alert_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per weather event, worded from its forecast."""
    chance = F.rint(F.col("rain_probability") * 100).cast("int")
    return events(spark, sf_dir, [C.WEATHER]).select(
        "event_uuid", "ts", "plot_id",
        F.lit("weather_alert").alias("alert_type"),
        F.when(chance >= 80, "high").when(chance >= 40, "medium").otherwise("low")
         .alias("severity"),
        F.concat(F.lit("Weather update: rain chance "), chance.cast("string"), F.lit("%"))
         .alias("message"),
    )


def attempts(messages: DataFrame, attempt: int = 1) -> DataFrame:
    """Delivery results for outbox rows; which ones fail follows from the alert id."""
    failing = ["0", "1"] if attempt == 1 else ["0"]
    ok = ~F.substring("alert_id", 1, 1).isin(failing)
    return messages.select(
        "alert_id", ok.alias("success"),
        F.when(ok, F.col("message_id")).alias("message_id"),
        F.col("route").alias("channel"),
        F.when(~ok, F.lit("provider timeout")).alias("error"),
        F.lit(attempt).alias("attempt"),
        (F.col("ts") + F.expr(f"interval {attempt} minutes")).alias("ts"),
        notify.letter_payload().alias("payload"),
    )
