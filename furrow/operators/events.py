"""Event layer: decode, route, union, deduplicate, order, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow import contracts as C
from furrow.functions import text

ISO_MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
EVENT_KEY = ["event_uuid", "plot_id"]


def parse(records: DataFrame) -> DataFrame:
    """Add the parsed event, and `bad_record` holding the text that does not fit the contract.

    One parse yields both; text that is no JSON object, or whose types differ, is bad. The parse
    result passes through a generator, which keeps the optimizer from repeating the parse in every
    filter and column above it.
    """
    body = F.col("value").cast("string")
    parsed = once(records, "event", F.from_json(
        body, f"{C.EVENT_DDL}, bad_record string", {"columnNameOfCorruptRecord": "bad_record"}))
    bad = F.when(F.col("event").isNull(), F.coalesce(body, F.lit("")))
    return parsed.withColumn("bad_record", F.coalesce(F.col("event.bad_record"), bad))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated one time per row."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def flatten(parsed: DataFrame, *keep: str) -> DataFrame:
    """Typed columns of parsed records, along with the named columns of the record itself."""
    e = F.col("event")
    return parsed.select(
        *keep,
        e.event_uuid.alias("event_uuid"),
        e.event_type.alias("event_type"),
        e.timestamp.try_cast("timestamp").alias("ts"),
        e.plot_id.alias("plot_id"),
        e.crop.alias("crop"),
        "event.data.*",
        e.data.forecast_3d.temp_max.alias("temp_max"),
        e.data.forecast_3d.rain_probability.alias("rain_probability"),
        e.metadata.battery_level.alias("battery_level"),
        e.metadata.soil_type.alias("soil_type"),
        e.metadata.farmer_id.alias("farmer_id"),
        e.metadata.channel.alias("channel"),
        e.metadata.location.lat.alias("lat"),
        e.metadata.location.lon.alias("lon"),
    ).drop("forecast_3d")


def decode(records: DataFrame) -> DataFrame:
    """Flat typed rows of the decodable records."""
    return flatten(parse(records).filter(F.col("bad_record").isNull()))


def poison(records: DataFrame) -> DataFrame:
    """The records `decode` leaves out, with their text."""
    return parse(records).filter(F.col("bad_record").isNotNull()).drop("event")


def to_topic_records(events: DataFrame) -> DataFrame:
    """Sink form: topic by event type, plot (else crop) as key, the event as JSON text."""
    body = F.struct(*[
        F.date_format(f.name, ISO_MICROS).alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in events.schema.fields
    ])
    return events.select(
        text.topic_of(F.col("event_type")).alias("topic"),
        F.coalesce("plot_id", "crop").alias("key"),
        F.to_json(body).alias("value"),
        F.substring("event_uuid", 1, 8).alias("short_id"),
    )


def select_types(events: DataFrame, *types: str) -> DataFrame:
    return events.filter(F.col("event_type").isin(list(types)))


def union_all(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union; a column one side lacks is null there."""
    out = first
    for other in others:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def with_plot_key(events: DataFrame) -> DataFrame:
    return events.withColumn("plot_id", F.coalesce("plot_id", F.lit(C.UNKNOWN_PLOT)))


def deduplicate(events: DataFrame, version: Column | None = None) -> DataFrame:
    """One row per event and plot, the newest version.

    An aggregate, so copies shrink to one row per task before the shuffle: an event that makes up
    a third of all rows costs its reducer one row per map task.
    """
    version = F.struct("ts") if version is None else version
    return keep_latest(events, EVENT_KEY, version)


def keep_latest(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Per key the row with the greatest version; null keys form one group, as in any GROUP BY."""
    newest = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rows.columns if c not in keys]), version).alias("_r")
    )
    return newest.select(*keys, "_r.*").select(*rows.columns)


def upsert(stored: DataFrame, arriving: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Merge by key, newest wins, without a table format: the union reduced to its latest rows."""
    return keep_latest(stored.unionByName(arriving), keys, version)


def insert_new(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """Arriving rows whose key is not stored yet; copies among them are merged, newest first.

    One grouping of both sides instead of a deduplication and an anti join: stored rows bring
    their key and a mark only, null keys match each other, and a key with many copies shrinks
    in the tasks that read it.
    """
    rest = [c for c in arriving.columns if c not in keys]
    offered = arriving.select(
        *keys, F.struct(*rest).alias("_r"), F.col("ts").alias("_v"), F.lit(False).alias("_stored"))
    known = stored.select(*keys, F.lit(True).alias("_stored"))
    met = offered.unionByName(known, allowMissingColumns=True).groupBy(*keys).agg(
        F.bool_or("_stored").alias("_stored"), F.max_by("_r", "_v").alias("_r"))
    return met.filter(~F.col("_stored")).select(*keys, "_r.*").select(*arriving.columns)


def sort_by_time(events: DataFrame) -> DataFrame:
    """Global order by time; the id breaks ties, so also one crowded instant splits by range."""
    return events.orderBy("ts", "event_uuid")


def order_per_plot(events: DataFrame) -> DataFrame:
    """Each plot's rows in time order, laid out in ranges of (plot, time).

    Ranges, not a hash of the plot: a plot with many rows is spread over neighbouring partitions
    instead of filling one.
    """
    order = ["plot_id", "ts", "event_uuid"]
    return events.repartitionByRange(*order).sortWithinPartitions(*order)


def count_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def round_readings(events: DataFrame) -> DataFrame:
    """Readings at the number of decimals their sources report."""
    known = {c: d for c, d in C.READING_DECIMALS.items() if c in events.columns}
    return events.withColumns({c: F.round(c, d) for c, d in known.items()})


def parse_plot_id(df: DataFrame, column: str = "plot_id") -> DataFrame:
    """Parts of a textual plot id and whether it has the agreed form and a known state."""
    parts = F.split(F.col(column), "_")
    formed = F.col(column).rlike(C.PLOT_ID_PATTERN)
    return df.withColumns({
        "state_code": F.get(parts, 0),
        "block_no": F.get(parts, 1).try_cast("int"),
        "field_no": F.get(parts, 2).try_cast("int"),
        "well_formed": F.coalesce(formed, F.lit(False)),
        "known_state": F.coalesce(F.get(parts, 0).isin(C.STATES), F.lit(False)),
    })


def report_features(reports: DataFrame) -> DataFrame:
    """What a farmer report says: pest, crop, image ids, and whether it lies inside the region."""
    sentence = C.REPORT_SENTENCE
    image = r"^s3://[^/]+/([^/]+)/([^/]+)\.jpg$"
    (lat_lo, lat_hi), (lon_lo, lon_hi) = C.RANGES[C.REPORT]["lat"], C.RANGES[C.REPORT]["lon"]

    def found(column: str, pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))

    return reports.select(
        "event_uuid", "plot_id", "report_type", "severity",
        found("description", sentence, 1).alias("pest"),
        found("description", sentence, 2).alias("crop"),
        F.col("image_url").isNotNull().alias("has_image"),
        found("image_url", image, 1).alias("image_plot"),
        found("image_url", image, 2).alias("image_file"),
        (F.col("lat").between(lat_lo, lat_hi) & F.col("lon").between(lon_lo, lon_hi))
        .alias("inside_region"),
    )
