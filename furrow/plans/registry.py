"""The registered queries: name -> (spark, folder of test tables) -> DataFrame.

Each reads the whole of its tables. Nested results are flattened to text or numbers so that they
can be compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.operators import (
    alerts, events, features, metrics, notify, quality, serving, similarity,
)
from furrow.functions import text
from furrow.sources import io, testbed
from furrow.session import checkpoint_root, configure, work_dir, zoneless
from furrow.streaming import hours, interval, jobs, progress
from furrow.streaming.changelog import ChangeLog
from furrow.streaming.keyed import InsertLog, UpsertTable

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return zoneless(fn(configure(spark), sf_dir.rstrip("/")))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    _REGISTRY[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# inputs shared by several queries ------------------------------------------------------------


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.plot_alerts(testbed.events(spark, sf, alerts.SOURCES))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    """Window alerts as messages; each alert type brings another channel setting."""
    channel = F.when(F.col("alert_type") == C.NDVI_ALERT[0], "") \
        .when(F.col("alert_type") == C.HEAT_ALERT[0], "email")
    return notify.to_messages(
        _alerts(spark, sf).withColumn("channel", channel), testbed.plots(spark, sf))


def _served_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return notify.to_serving(_messages(spark, sf))


def _kept(df: DataFrame) -> DataFrame:
    """A result several branches of a query use: written once to the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def _acks(alert_rows: DataFrame) -> DataFrame:
    """Acknowledged are all alerts of medium severity."""
    return alert_rows.filter(F.col("severity") == "medium").select("alert_id")


def _outbox(spark: SparkSession, sf: str) -> DataFrame:
    return notify.outbox(_messages(spark, sf), testbed.contacts(spark, sf))


def _payloads(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.payloads(testbed.events(spark, sf))


def _joined(array: str) -> Column:
    return F.array_join(array, ",").alias(array)


# event layer ---------------------------------------------------------------------------------


@query
def decode_events(spark, sf):
    return events.decode(_payloads(spark, sf)).select(
        "event_uuid", "event_type", "ts", "plot_id", "crop", "ndvi", "temperature_c", "temp_max",
        "moisture_pct", "description", "price_per_quintal_inr", "soil_type", "lat")


@query
def json_roundtrip(spark, sf):
    path = work_dir(spark, "json")
    packed = testbed.events(spark, sf).select(
        "event_uuid", "event_type", F.date_format("ts", events.ISO_MICROS).alias("timestamp"),
        "plot_id", "crop",
        F.struct("ndvi", "temperature_c", "moisture_pct", "price_per_quintal_inr").alias("data"))
    io.write_json_lines(packed, path)
    return io.read_json_lines(spark, path).select(
        "event_uuid", "event_type", "timestamp", "plot_id", "crop", "data.ndvi",
        "data.temperature_c", "data.moisture_pct", "data.price_per_quintal_inr")


@query
def json_array_roundtrip(spark, sf):
    """The same through indented files of one array each, read in splits."""
    path = work_dir(spark, "array")
    io.write_json_array(testbed.events(spark, sf).select(
        "event_uuid", "event_type", F.date_format("ts", events.ISO_MICROS).alias("timestamp"),
        "plot_id", "crop",
        F.struct("ndvi", "temperature_c", "moisture_pct", "price_per_quintal_inr").alias("data")), path)
    return io.read_json_array(spark, path, 8 << 20).select(
        "event_uuid", "event_type", "timestamp", "plot_id", "crop", "data.ndvi",
        "data.temperature_c", "data.moisture_pct", "data.price_per_quintal_inr")


@query
def topic_route(spark, sf):
    return events.to_topic_records(
        testbed.events(spark, sf).select("event_uuid", "event_type", "ts", "plot_id", "crop"))


@query
def lake_curated(spark, sf):
    path = work_dir(spark, "lake")
    io.write_lake(testbed.events(spark, sf).select(
        "event_uuid", "event_type", "ts", "plot_id", "ndvi", "temperature_c"), path)
    return io.read_lake(spark, path).groupBy("event_type", "event_date").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max("ndvi").alias("max_ndvi"), F.max("temperature_c").alias("max_temp"),
    ).withColumn("event_date", F.col("event_date").cast("string"))


@query
def union_streams(spark, sf):
    parts = [
        testbed.events(spark, sf, [t]).select("event_uuid", "event_type", "ts", "plot_id", *cols)
        for t, cols in ((C.WEATHER, ["temperature_c", "humidity_pct"]), (C.SATELLITE, ["ndvi"]),
                        (C.SOIL, ["temperature_c", "moisture_pct"]))
    ]
    return events.union_all(*parts)


@query
def unknown_plot_key(spark, sf):
    keyed = events.with_plot_key(testbed.flawed(testbed.events(spark, sf, alerts.SOURCES)))
    return keyed.groupBy("plot_id", "event_type").agg(F.count(F.lit(1)).alias("n_events"))


@query
def dedup_events(spark, sf):
    sent_twice = testbed.redelivered(testbed.events(spark, sf))
    return events.deduplicate(
        sent_twice.select("event_uuid", "plot_id", "event_type", "ts", "measure"))


@query
def upsert_latest(spark, sf):
    stored = testbed.events(spark, sf).select(
        "event_uuid", "plot_id", "event_type", "ts", "measure")
    update = stored.withColumns({
        "ts": F.col("ts") + F.when(F.col("event_type") == C.MARKET,
                                   F.expr("interval 1 hour")).otherwise(
                                       F.expr("interval -1 hour")),
        "measure": F.col("measure") + 1.0})
    return events.upsert(stored, update, events.EVENT_KEY, F.struct("ts", "event_uuid"))


@query
def idempotent_insert(spark, sf):
    arriving = testbed.redelivered(testbed.events(spark, sf)).select(
        "event_uuid", "plot_id", "event_type", "ts", "measure")
    stored = testbed.events(spark, sf).filter(F.col("ts") < "2024-01-16")
    return events.insert_new(stored, arriving, events.EVENT_KEY)


STORED_DDL = "event_uuid string, plot_id string, event_type string, ts timestamp, measure double"


@query
def stored_upsert(spark, sf):
    """The merge into a stored table: events first, then updates in four batches by id."""
    update = testbed.events(spark, sf).select(
        "event_uuid", "plot_id", "event_type",
        (F.col("ts") + F.when(F.col("event_type") == C.MARKET, F.expr("interval 1 hour")).otherwise(
            F.expr("interval -1 hour"))).alias("ts"), (F.col("measure") + 1.0).alias("measure"))
    table = UpsertTable(spark, work_dir(spark, "stored"), events.EVENT_KEY, STORED_DDL, ["ts", "event_uuid"])
    table.upsert(testbed.events(spark, sf))
    for part in range(4):
        table.upsert(update.filter(F.pmod(F.xxhash64("event_uuid"), F.lit(4)) == part))
    return table.current()


@query
def stored_insert(spark, sf):
    """Idempotent insert into a stored log: what is stored first is asked for by key filters."""
    sent = testbed.events(spark, sf)
    log = InsertLog(spark, work_dir(spark, "stored"), events.EVENT_KEY, STORED_DDL)
    log.insert(sent.filter(F.col("ts") < "2024-01-16"), 0)
    log.insert(testbed.redelivered(sent), 1)
    return log.rows().filter("batch_id = 1").drop("batch_id")


@query
def events_sorted(spark, sf):
    return events.sort_by_time(
        testbed.events(spark, sf).select("event_uuid", "event_type", "ts", "plot_id", "crop"))


@query
def per_plot_order(spark, sf):
    return events.order_per_plot(
        testbed.events(spark, sf).select("plot_id", "ts", "event_uuid", "event_type"))


@query
def event_counts(spark, sf):
    return events.count_by_type(testbed.events(spark, sf))


@query
def round_readings(spark, sf):
    """Readings with a stray further digit, brought back to their decimals: ndvi goes up, the
    others down."""
    rows = testbed.events(spark, sf)
    return events.round_readings(rows.select(
        "event_uuid", (F.col("ndvi") + 0.0007).alias("ndvi"),
        (F.col("humidity_pct") + 0.03).alias("humidity_pct"),
        (F.col("precipitation_mm") + 0.002).alias("precipitation_mm"),
        (F.col("ph") + 0.004).alias("ph")))


@query
def plot_id_parse(spark, sf):
    raw = testbed.table(spark, sf, "events")
    code = F.element_at(F.array(*[F.lit(s) for s in C.STATES]),
                        (F.col("user_id") % 10 + 1).cast("int"))
    name = F.concat_ws(
        "_", code, (F.col("user_id") % 900 + 100).cast("string"),
        (F.col("user_id") % 500 + 1).cast("string"))
    k = F.get_json_object("props", "$.k").cast("int")
    named = raw.select("event_id", F.when(k == 41, F.lower(name)).when(k == 42, F.lit("plot"))
                       .otherwise(name).alias("plot_id"))
    return events.parse_plot_id(named)


@query
def report_features(spark, sf):
    return events.report_features(testbed.events(spark, sf, [C.REPORT]))


# alerts --------------------------------------------------------------------------------------


@query
def hourly_plot_metrics(spark, sf):
    return alerts.hourly_metrics(testbed.events(spark, sf, alerts.SOURCES))


@query
def salted_metrics(spark, sf):
    return alerts.salted_metrics(testbed.events(spark, sf, alerts.SOURCES))


@query
def hot_salted_metrics(spark, sf):
    return alerts.hot_salted_metrics(testbed.events(spark, sf, alerts.SOURCES))


@query
def plot_alerts(spark, sf):
    return _alerts(spark, sf)


@query
def heat_air_only(spark, sf):
    return alerts.air_heat_alerts(testbed.events(spark, sf, [C.WEATHER]))


# notification --------------------------------------------------------------------------------


@query
def alert_message_shape(spark, sf):
    return _messages(spark, sf).drop("metadata")


@query
def alert_contact(spark, sf):
    return notify.with_contact(_messages(spark, sf), testbed.contacts(spark, sf)).select(
        "alert_id", "farmer_id", "phone", "preferred_language", "preferred_channel")


@query
def format_alert(spark, sf):
    return _messages(spark, sf).select("alert_id", text.display_message(
        F.col("plot_id"), F.col("alert_type"), F.col("severity"), F.col("message_en"))
        .alias("display"))


@query
def translate_alerts(spark, sf):
    """Messages with an irrigation, a weather and (from reports) a pest keyword, and others."""
    drawn = _messages(spark, sf).select(F.col("farmer_id"), F.col("message_en"))
    asked = testbed.alert_requests(spark, sf).select(
        F.col("plot_id").alias("farmer_id"), F.col("message").alias("message_en"))
    told = testbed.events(spark, sf, [C.REPORT]).select(
        "farmer_id", F.concat_ws(": ", "report_type", "description").alias("message_en"))
    messages = drawn.unionByName(asked).unionByName(told) \
        .withColumn("message_local", F.lit(None).cast("string"))
    return notify.translate(notify.with_contact(messages, testbed.contacts(spark, sf))).select(
        "farmer_id", "message_en", "preferred_language", "message_local")


@query
def channel_route(spark, sf):
    contacted = notify.with_contact(_messages(spark, sf), testbed.contacts(spark, sf))
    return notify.route(notify.compose(contacted)).select(
        "alert_id", "channel", "preferred_channel", "route", "subject", "body")


@query
def notify_outbox(spark, sf):
    return _outbox(spark, sf)


@query
def bulk_send_summary(spark, sf):
    return notify.delivery_summary(testbed.attempts(_outbox(spark, sf)))


@query
def dlq_records(spark, sf):
    tried = testbed.attempts(_outbox(spark, sf))
    letters = notify.dead_letters(tried, events.poison(_payloads(spark, sf)))
    held = F.when(F.col("kind") == "delivery", F.from_json("payload", notify.LETTER_DDL))
    return letters.withColumn("m", held).select(
        "kind", "ref", "error", "attempts", "ts",
        F.when(F.col("kind") == "record", F.col("payload")).alias("bad_record"),
        "m.route", "m.phone", "m.subject", "m.body")


@query
def dlq_retry(spark, sf):
    """What the letters hold is sent again; nothing else is asked."""
    letters = _kept(notify.failed(testbed.attempts(_outbox(spark, sf))))
    again = testbed.attempts(notify.resendable(letters).withColumns({
        "message_id": F.lit(None).cast("string"), "ts": F.lit(None).cast("timestamp")}), 2)
    return notify.retry(letters, again)


@query
def dlq_retry_tally(spark, sf):
    outcome = dlq_retry(spark, sf)
    return outcome.agg(
        F.count_if("recovered").alias("recovered"),
        F.count_if(~F.col("recovered")).alias("still_failing"))


# serving -------------------------------------------------------------------------------------


@query
def latest_weather(spark, sf):
    return serving.latest_weather(testbed.events(spark, sf, [C.WEATHER]))


@query
def latest_soil(spark, sf):
    return serving.latest_soil(testbed.events(spark, sf, [C.SOIL]))


def _status(spark, sf):
    return serving.plot_status(
        testbed.plots(spark, sf), testbed.events(spark, sf, alerts.SOURCES), _alerts(spark, sf))


@query
def plot_status(spark, sf):
    return _status(spark, sf).select(
        "plot_id", "crop_type", "health_score", "last_updated",
        F.array_join(F.transform("alerts", lambda a: F.concat_ws(
            " ", F.date_format(a.ts, "yyyy-MM-dd HH:mm:ss"), a.type, a.severity)), ",")
        .alias("alerts"),
        _joined("recommendations"))


@query
def plot_lookup(spark, sf):
    """The plot with the most alerts."""
    busiest = _alerts(spark, sf).groupBy("plot_id").agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.max_by("plot_id", F.struct("n", "plot_id")).alias("p"))
    return serving.plot_lookup(testbed.plots(spark, sf), busiest.scalar())


@query
def recent_alerts(spark, sf):
    return serving.recent_alerts(_served_alerts(spark, sf), limit=10)


@query
def recent_alerts_of_plot(spark, sf):
    """The newest five of the plot with the most."""
    rows = _kept(_served_alerts(spark, sf))
    busiest = rows.groupBy("plot_id").agg(F.count(F.lit(1)).alias("n")) \
        .agg(F.max_by("plot_id", F.struct("n", "plot_id")).alias("p")).first()[0]
    return serving.recent_alerts(rows, busiest, limit=5)


@query
def recent_alerts_per_plot(spark, sf):
    return serving.recent_alerts_per_plot(_served_alerts(spark, sf), 3)


@query
def ack_alerts(spark, sf):
    rows = _kept(_served_alerts(spark, sf))
    return serving.acknowledge(rows, _acks(rows))


@query
def plots_with_open_alerts(spark, sf):
    rows = _kept(_served_alerts(spark, sf))
    return serving.plots_with_open_alerts(
        testbed.plots(spark, sf), serving.acknowledge(rows, _acks(rows)))


@query
def create_alerts(spark, sf):
    return serving.create_alerts(testbed.alert_requests(spark, sf))


@query
def manual_reports(spark, sf):
    return serving.manual_reports(testbed.events(spark, sf, [C.REPORT]))


@query
def alerts_appended(spark, sf):
    """Created alerts and manual reports appended to one table and read back."""
    path = work_dir(spark, "served")
    for rows in (create_alerts(spark, sf), manual_reports(spark, sf)):
        io.append_alerts(rows, path)
    return io.read_alerts(spark, path)


# quality and ingestion -----------------------------------------------------------------------


def _flawed(spark, sf):
    return testbed.flawed(testbed.events(spark, sf))


@query
def dq_ranges(spark, sf):
    return quality.range_report(_flawed(spark, sf))


@query
def dq_membership(spark, sf):
    return quality.membership_report(_flawed(spark, sf))


@query
def dq_summary(spark, sf):
    return quality.summary(_flawed(spark, sf))


@query
def dq_health_score(spark, sf):
    """Plots whose health score lies outside its range."""
    return quality.tally(_status(spark, sf), quality.health_rules())


@query
def dq_uniqueness(spark, sf):
    """Every tenth id comes twice."""
    sent = testbed.events(spark, sf)
    return quality.repeated_ids(sent.unionByName(sent.filter(F.col("event_uuid").cast("long") % 10 == 0)))


@query
def dq_quarantine(spark, sf):
    judged = quality.with_reasons(_flawed(spark, sf))
    return judged.select(
        "event_uuid", F.when(F.size("reasons") == 0, "accepted").otherwise("quarantined")
        .alias("outcome"), _joined("reasons"))


@query
def contract_drift(spark, sf):
    return quality.contract_drift(_payloads(spark, sf))


@query
def contract_typed_drift(spark, sf):
    """Every 50th record sends a number as text, every 97th has no event type."""
    number = F.col("record_id").cast("long")
    sent = F.when(number % 50 == 0, F.regexp_replace(
        "value", '"humidity_pct":([0-9.]+)', '"humidity_pct":"$1"')).when(
            number % 97 == 0, F.replace("value", F.lit('"event_type"'), F.lit('"kind"'))).otherwise(
                F.col("value"))
    return quality.typed_drift(_payloads(spark, sf).select(sent.alias("value")))


@query
def ingest_run_metrics(spark, sf):
    return quality.run_metrics(testbed.events(spark, sf), 20)


@query
def cadence_gaps(spark, sf):
    return quality.cadence_gaps(
        testbed.events(spark, sf), testbed.plots(spark, sf), "2024-01-01", "2024-01-30")


def _ingest(spark, sf, event_type):
    root = work_dir(spark, "ingest")
    landed = testbed.stream_events(spark, sf, [event_type])
    records = testbed.payloads(testbed.flawed(landed))
    jobs.run_available(jobs.ingest(records, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/*/*/*").select(
        "record_id", "outcome", "topic", "key", _joined("reasons"))


@query
def ingest_weather(spark, sf):
    return _ingest(spark, sf, C.WEATHER)


@query
def ingest_satellite(spark, sf):
    return _ingest(spark, sf, C.SATELLITE)


@query
def ingest_market(spark, sf):
    return _ingest(spark, sf, C.MARKET)


# joins and features --------------------------------------------------------------------------


@query
def windowed_join(spark, sf):
    return features.windowed_join(testbed.events(spark, sf), testbed.plots(spark, sf))


@query
def asof_weather(spark, sf):
    return features.asof_weather(testbed.events(spark, sf, [C.SATELLITE, C.WEATHER]))


@query
def price_change(spark, sf):
    return features.price_change(testbed.events(spark, sf, [C.MARKET]))


@query
def plot_market_price(spark, sf):
    return features.market_price_per_plot(
        testbed.plots(spark, sf), testbed.events(spark, sf, [C.MARKET]))


@query
def plot_daily_features(spark, sf):
    return features.daily_features(testbed.events(spark, sf, alerts.SOURCES))


@query
def rolling_24h(spark, sf):
    return features.rolling_mean(testbed.events(spark, sf, [C.WEATHER]))


# pipeline health -----------------------------------------------------------------------------


@query
def ingest_rate(spark, sf):
    return metrics.ingest_rate(metrics.topic_counter(testbed.events(spark, sf)))


@query
def hist_p95(spark, sf):
    buckets = metrics.bucket_counts(testbed.events(spark, sf), F.col("measure"))
    return metrics.histogram_quantile(buckets, 0.95, ["window_start"])


@query
def alerts_sent_hourly(spark, sf):
    sent = metrics.minute_counts(testbed.events(spark, sf, [C.REPORT]), F.col("channel"))
    return metrics.hourly_increase(metrics.daily_counter(sent, ["channel"]), ["channel"])


@query
def dlq_alarm(spark, sf):
    """Soil messages of the day so far stand in for the gauge of dead letters."""
    letters = metrics.minute_counts(testbed.events(spark, sf, [C.SOIL]), F.lit("soil").alias("q"))
    return metrics.gauge_alarm(metrics.daily_counter(letters, ["q"]))


@query
def dlq_arrivals_alarm(spark, sf):
    return metrics.arrivals_alarm(testbed.events(spark, sf, [C.SOIL]), limit=5)


@query
def consumer_lag(spark, sf):
    totals = metrics.partition_totals(testbed.events(spark, sf), F.col("k") >= 33)
    return metrics.consumer_lag(totals, ["topic", "partition"], limit=100)


@query
def latency_p95(spark, sf):
    rows = testbed.events(spark, sf)
    return metrics.latency_p95(
        rows.withColumn("day", F.to_date("ts").cast("string")), F.col("measure"),
        ["event_type", "day"], 150.0).withColumn("p95", F.round("p95", 6))


@query
def latency_sketches(spark, sf):
    """Percentiles from sketches per minute, merged step by step, against the ranks of all values."""
    rows, keys = testbed.events(spark, sf), ["event_type"]
    sketches = metrics.latency_sketches(rows, F.col("measure"), keys)
    checked = []
    for span in ("5 minutes", "1 hour", "1 day"):
        sketches = metrics.rolled_up(sketches, keys, span)
        report = metrics.sketch_report(sketches, keys, C.LATENCY_P95_LIMIT_MS)
        checked.append(metrics.sketch_check(rows, F.col("measure"), report, keys, span).select(
            F.lit(span).alias("span"), "event_type", "start", "n", "within"))
    return events.union_all(*checked)


@query
def run_success_rate(spark, sf):
    runs = quality.run_metrics(testbed.events(spark, sf)).withColumn(
        "success", F.col("records") % 2 == 0)
    return metrics.success_rate(runs)


@query
def data_drift(spark, sf):
    readings = {
        "ndvi": C.RANGES[C.SATELLITE]["ndvi"], "humidity_pct": C.RANGES[C.WEATHER]["humidity_pct"],
        "moisture_pct": C.RANGES[C.SOIL]["moisture_pct"],
    }
    drift = metrics.data_drift(
        testbed.events(spark, sf), F.col("ts") >= "2024-01-16", readings)
    return drift.select("reading", *[
        F.round(c, 6).alias(c) for c in drift.columns if c != "reading"])


@query
def knn_topk(spark, sf):
    vectors = testbed.table(spark, sf, "embeddings")
    found = similarity.knn(vectors, similarity.sampled_queries(vectors), 10)
    return found.withColumn("score", F.round("score", 6))


# streams -------------------------------------------------------------------------------------


@query
def stream_bronze(spark, sf):
    root = work_dir(spark, "bronze")
    records = testbed.payloads(testbed.stream_events(spark, sf, maxFilesPerTrigger=64))
    jobs.run_available(jobs.append_files(records, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").select("record_id", "topic", "key", "received")


def _shuffled(spark, sf, rows, label, files=6):
    """A stream over rows that land in files of no order in time, one file per micro-batch."""
    path = work_dir(spark, label)
    rows.repartition(files, F.xxhash64("event_uuid", "ts")).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _sensor_stream(spark, sf):
    return _shuffled(spark, sf, testbed.events(spark, sf, alerts.SOURCES).select(
        "event_uuid", "event_type", "ts", "plot_id", "ndvi", "moisture_pct", "temperature_c"), "landing")


@query
def stream_alerts(spark, sf):
    """Alerts drawn from hourly sums that several out-of-order micro-batches added to."""
    root = work_dir(spark, "alerts")
    log = jobs.metric_log(spark, f"{root}/sums")
    jobs.run_available(jobs.metric_updates([_sensor_stream(spark, sf)], log, f"{root}/checkpoint"))
    return alerts.alerts_from(alerts.averages(log.current()))


@query
def stream_alert_sink(spark, sf):
    """The same alerts from the sink that each micro-batch brings up to date."""
    root = work_dir(spark, "alert-sink")
    sink = jobs.alert_log(spark, f"{root}/alerts")
    jobs.run_available(jobs.metric_updates(
        [_sensor_stream(spark, sf)], jobs.metric_log(spark, f"{root}/sums"), f"{root}/checkpoint", sink))
    return jobs.current_alerts(sink)


@query
def stream_closed_hours(spark, sf):
    """Hours closed once by their timers, late readings put back: all readings, over batches of no
    order in time. A row far ahead, of no real plot, lets the last hours close."""
    root = work_dir(spark, "hours")
    rows = testbed.events(spark, sf, alerts.SOURCES).select("ts", "plot_id", "ndvi", "moisture_pct", "temperature_c")
    landing = work_dir(spark, "landing")
    rows.repartition(6, F.xxhash64("ts", "plot_id")).write.parquet(landing)
    rows.agg(F.timestamp_add("DAY", F.lit(2), F.max("ts")).alias("ts")).filter("ts IS NOT NULL").select(
        "ts", F.lit("end of stream").alias("plot_id"),
        *[F.lit(None).cast("double").alias(name) for name in rows.columns[2:]]).coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    jobs.run_available(jobs.append_files(
        hours.hour_stream(stream), f"{root}/out", f"{root}/checkpoint", "kind"))
    return hours.corrected(spark.read.parquet(f"{root}/out")).filter(
        F.col("plot_id") != "end of stream")


@query
def stream_admission(spark, sf):
    """A landing of many files taken in batches of bounded bytes, and what the listener saw of it."""
    root = work_dir(spark, "admission")
    rows = testbed.events(spark, sf).select("event_uuid", "ts", "plot_id", "measure")
    rows.repartition(24, "event_uuid").write.parquet(f"{root}/in")
    sizes = spark.read.parquet(f"{root}/in").select("_metadata.file_path", "_metadata.file_size").distinct()
    largest, total = sizes.agg(F.max("file_size"), F.sum("file_size")).first()
    bound = max(largest or 1, (total or 0) // 5)
    seen = progress.ProgressLog()
    spark.streams.addListener(seen)
    try:
        run = jobs.run_available(progress.files_taken(
            spark.readStream.schema(rows.schema).option("maxBytesPerTrigger", bound).parquet(f"{root}/in"),
            f"{root}/taken", f"{root}/checkpoint"))
        told = seen.wait(spark, str(run.id))
    finally:
        spark.streams.removeListener(seen)
    taken = spark.read.parquet(f"{root}/taken").groupBy("batch_id").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    return taken.join(told, "batch_id", "left").agg(
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.coalesce(F.bool_and(F.col("bytes") <= bound), F.lit(True)).alias("bytes_within_bound"),
        F.coalesce(F.bool_and(F.coalesce(F.col("rows") == F.col("input_rows"), F.lit(False))), F.lit(True))
        .alias("listener_agrees"))


@query
def stream_dedup(spark, sf):
    """Of events of which every tenth is sent twice, the copies being equal, one stays."""
    root = work_dir(spark, "dedup")
    sent = testbed.events(spark, sf).select("event_uuid", "plot_id", "event_type", "ts", "measure")
    twice = sent.unionByName(sent.filter(F.col("event_uuid").cast("long") % 10 == 0)) \
        .withColumn("copy", F.monotonically_increasing_id())
    path = work_dir(spark, "landing")
    twice.repartition(6, F.xxhash64("event_uuid", "copy")).drop("copy").write.parquet(path)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = InsertLog(spark, f"{root}/log", events.EVENT_KEY, STORED_DDL)
    jobs.run_available(jobs.first_arrivals(stream, log, f"{root}/checkpoint"))
    return log.rows().drop("batch_id")


@query
def stream_upsert(spark, sf):
    root = work_dir(spark, "upsert")
    log = ChangeLog(spark, f"{root}/log", events.EVENT_KEY,
                    "event_uuid string, plot_id string, event_type string, ts timestamp, "
                    "measure double", version=["ts"])
    sent = testbed.redelivered(testbed.stream_events(spark, sf)).select(
        "event_uuid", "plot_id", "event_type", "ts", "measure")
    jobs.run_available(jobs.upserts(sent, log, f"{root}/checkpoint"))
    return log.current()


@query
def fanout_split(spark, sf):
    root = work_dir(spark, "fanout")
    source = testbed.stream_events(spark, sf).select(
        "event_uuid", "event_type", "plot_id", "severity", "measure")
    branches = {
        "dashboard": "true",
        "alerting": "severity in ('high', 'critical')",
        "training": f"event_type in ('{C.SATELLITE}', '{C.WEATHER}', '{C.SOIL}')",
    }
    jobs.run_available(jobs.fan_out(source, branches, root, f"{root}/checkpoint"))
    parts = [
        spark.read.parquet(f"{root}/{name}").select(F.lit(name).alias("consumer"), "event_uuid")
        for name in branches
    ]
    return events.union_all(*parts)


@query
def stream_interval_join(spark, sf):
    """Every satellite pass with the weather of the six hours before it, or without."""
    root = work_dir(spark, "interval")
    log = ChangeLog(spark, f"{root}/log", ["pass_id"], jobs.JOIN_DDL)
    passes = testbed.events(spark, sf, [C.SATELLITE]).select("event_uuid", "plot_id", "ts", "ndvi")
    readings = testbed.events(spark, sf, [C.WEATHER]).select("event_uuid", "plot_id", "ts", "temperature_c")
    jobs.run_available(jobs.interval_updates(
        _shuffled(spark, sf, passes, "passes"), _shuffled(spark, sf, readings, "readings"),
        f"{root}/rows", log, f"{root}/checkpoint"))
    return jobs.current_pairs(log)


@query
def stream_engine_join(spark, sf):
    """The same in the engine's join state, in instalments of no order in time; rows far ahead, of no
    real plot, let the last passes without a reading come out."""
    root, end = work_dir(spark, "engine-join"), "end of stream"
    join = interval.IntervalJoin(spark, f"{root}/join")
    sides = {
        "passes": testbed.events(spark, sf, [C.SATELLITE]).select("event_uuid", "plot_id", "ts", "ndvi"),
        "readings": testbed.events(spark, sf, [C.WEATHER]).select("event_uuid", "plot_id", "ts", "temperature_c"),
    }
    ahead = testbed.events(spark, sf).agg(F.timestamp_add("DAY", F.lit(2), F.max("ts")).alias("ts"))
    for n in range(4):
        for name, rows in sides.items():
            part = rows.filter(F.pmod(F.xxhash64("event_uuid"), F.lit(3)) == n) if n < 3 else ahead.select(
                F.lit(end).alias("event_uuid"), F.lit(end).alias("plot_id"), "ts",
                F.lit(0.0).alias(rows.columns[3]))
            part.write.mode("append").parquet(f"{root}/{name}")
        join.run(*(spark.readStream.schema(rows.schema).parquet(f"{root}/{name}")
                   for name, rows in sides.items()))
    return join.pairs().filter(F.col("pass_id") != end)


@query
def late_events(spark, sf):
    """Events arrive k hours after they happen, in instalments of ten days."""
    root = work_dir(spark, "late")
    arrival = F.col("ts") + F.make_interval(hours=F.col("k"))
    instalment = F.floor(
        F.datediff(arrival, F.lit("2024-01-01").cast("date")) / F.lit(10)).cast("int")
    sent = testbed.events(spark, sf).select(
        "event_uuid", "plot_id", "ts", instalment.alias("instalment"))
    log = ChangeLog(spark, f"{root}/newest", ["plot_id"], "plot_id string, newest timestamp",
                    version=["newest"])
    last = sent.agg(F.max("instalment")).first()[0]
    for n in range(last + 1):
        sent.filter(F.col("instalment") == n).write.mode("append").parquet(f"{root}/landing")
        landed = spark.readStream.schema(sent.schema).parquet(f"{root}/landing")
        jobs.run_available(
            jobs.late_split(landed, log, f"{root}/out", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/out").select(
        "event_uuid", "plot_id", "ts", "instalment", F.col("late").cast("boolean").alias("late"))


@query
def stream_last_reading(spark, sf):
    root = work_dir(spark, "last")
    readings = ["ndvi", "moisture_pct", "temperature_c"]
    log = ChangeLog(
        spark, f"{root}/log", ["plot_id"],
        "plot_id string, " + ", ".join(f"last_{r} double" for r in readings)
        + ", last_ts timestamp")
    latest = jobs.last_readings(testbed.stream_events(spark, sf, alerts.SOURCES), readings)
    jobs.run_available(
        latest.writeStream.outputMode("update").foreachBatch(log.write)
        .option("checkpointLocation", f"{root}/checkpoint"))
    return log.current()
