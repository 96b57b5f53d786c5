from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.operators import alerts, events
from furrow.sources import testbed
from furrow.streaming import jobs
from furrow.streaming.changelog import ChangeLog
from furrow.streaming.keyed import InsertLog
from helpers import EVENT_DDL, at, event_rows


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENT_DDL).parquet(path)


def test_stream_in_shuffled_instalments_equals_batch(spark, sf_dir, tmp_path):
    """Sums over files of no order in time, with compactions on the way."""
    rows = testbed.events(spark, sf_dir, alerts.SOURCES).select(
        *[c for c in ("event_uuid", "event_type", "ts", "plot_id", "ndvi", "moisture_pct",
                      "temperature_c")])
    root = str(tmp_path)
    log, sink = jobs.metric_log(spark, f"{root}/log"), jobs.alert_log(spark, f"{root}/alerts")
    log.compact_every = sink.compact_every = 2
    rows.repartition(7, "event_uuid").write.parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.run_available(jobs.metric_updates(
        [source.filter(F.col("event_type") == t) for t in alerts.SOURCES], log, f"{root}/ckpt", sink))
    assert len(log._numbers("changes")) <= 5 and len(log._numbers("snapshots")) <= 2
    columns = ["plot_id", "window_start", "window_end", "avg_ndvi", "avg_moisture", "avg_temp"]
    expected = sorted(map(str, alerts.hourly_metrics(rows).select(columns).collect()))
    assert sorted(map(str, alerts.averages(log.current()).select(columns).collect())) == expected
    assert sorted(map(str, jobs.current_alerts(sink).collect())) == \
        sorted(map(str, alerts.plot_alerts(rows).collect()))


def test_closed_windows_are_raised_once(spark, tmp_path):
    root = str(tmp_path)
    for i in range(3):
        land(event_rows(spark, {"event_uuid": f"e{i}", "event_type": C.SATELLITE, "ndvi": 0.25,
                                "ts": at(hours=4 * i)}), f"{root}/in")
        jobs.run_available(jobs.append_files(
            jobs.closed_alerts(stream(spark, f"{root}/in")), f"{root}/out", f"{root}/ckpt"))
    ends = sorted(r.window_end for r in spark.read.parquet(f"{root}/out").collect())
    assert ends == [at(hours=1), at(hours=5)]


def test_late_rows_are_kept_and_tagged(spark, tmp_path):
    root = str(tmp_path)
    log = ChangeLog(spark, f"{root}/newest", ["plot_id"], "plot_id string, newest timestamp",
                    version=["newest"], compact_every=2)

    def run(*rows):
        land(event_rows(spark, *rows), f"{root}/in")
        jobs.run_available(jobs.late_split(
            stream(spark, f"{root}/in"), log, f"{root}/out", f"{root}/ckpt"))

    run({"event_uuid": "a", "ts": at(hours=5)}, {"event_uuid": "b", "ts": at()})
    run({"event_uuid": "c", "ts": at(hours=3)}, {"event_uuid": "d", "ts": at(hours=4)},
        {"event_uuid": "e", "plot_id": "other"})
    run({"event_uuid": "f", "ts": at(hours=4, minutes=-1)})
    late = {r.event_uuid: r.late in (True, "true")
            for r in spark.read.parquet(f"{root}/out").collect()}
    assert late == {"a": False, "b": False, "c": True, "d": False, "e": False, "f": True}


def test_a_replayed_batch_leaves_no_trace(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path), ["k"], "k string, v int")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    second = spark.createDataFrame([("a", 2)], "k string, v int")
    log.write(first, 0)
    log.write(second, 1)
    log.write(second, 1)
    assert sorted(log.current().collect()) == [("a", 2), ("b", 1)]
    assert log.rows().count() == 3
    assert sorted(log.current(before=1).collect()) == [("a", 1), ("b", 1)]
    log.compact()
    log.write(spark.createDataFrame([("c", 9)], "k string, v int"), 2)
    assert sorted(log.current().collect()) == [("a", 2), ("b", 1), ("c", 9)]
    assert log.rows().count() == 3


def test_dedup_stream_over_batches(spark, tmp_path):
    root = str(tmp_path)
    log = InsertLog(spark, f"{root}/log", events.EVENT_KEY, EVENT_DDL)
    for i in range(2):
        land(event_rows(spark, {"event_uuid": "a", "ndvi": 0.1 * i}, {"event_uuid": "a", "plot_id": None},
                        {"event_uuid": f"new{i}", "ts": at(hours=-9 * i)},
                        {"event_uuid": f"new{i}", "ts": at(hours=-9 * i, minutes=1)}), f"{root}/in")
        jobs.run_available(jobs.first_arrivals(stream(spark, f"{root}/in"), log, f"{root}/ckpt"))
    got = {(r.event_uuid, r.plot_id): r for r in log.rows().collect()}
    assert log.rows().count() == len(got) == 4
    assert got["a", "WB_123_45"].ndvi == 0.0 and got["new1", "WB_123_45"].ts == at(hours=-9)


def test_upsert_stream_is_idempotent(spark, tmp_path):
    root = str(tmp_path)
    log = ChangeLog(spark, f"{root}/log", events.EVENT_KEY, EVENT_DDL, version=["ts"])
    for minute, ndvi in ((5, 0.5), (9, 0.9), (1, 0.1)):
        land(event_rows(spark, {"event_uuid": "a", "ts": at(minute), "ndvi": ndvi}), f"{root}/in")
        jobs.run_available(jobs.upserts(stream(spark, f"{root}/in"), log, f"{root}/ckpt"))
    row, = log.current().collect()
    assert row.ndvi == 0.9


def test_interval_join_in_any_order(spark, tmp_path):
    root = str(tmp_path)
    sat, rain = f"{root}/sat", f"{root}/rain"
    log = ChangeLog(spark, f"{root}/log", ["pass_id"], jobs.JOIN_DDL)

    def run(passes, readings):
        land(event_rows(spark, *passes), sat)
        land(event_rows(spark, *readings), rain)
        jobs.run_available(jobs.interval_updates(
            stream(spark, sat), stream(spark, rain), f"{root}/rows", log, f"{root}/ckpt"))

    run([{"event_uuid": "p3", "ndvi": 0.4, "ts": at(hours=72)}],
        [{"event_uuid": "w3", "temperature_c": 32.0, "ts": at(hours=72)}])
    # days before the rows above, and a pass before its reading
    run([{"event_uuid": "p1", "ndvi": 0.4, "ts": at(hours=6)},
         {"event_uuid": "p2", "ndvi": 0.4, "ts": at(hours=14)},
         {"event_uuid": "p4", "ndvi": 0.4, "ts": at(), "plot_id": None}],
        [{"event_uuid": "w2", "temperature_c": 31.0, "ts": at(hours=7)}])
    run([{"event_uuid": "p5", "ndvi": 0.4, "ts": at(hours=100)}],
        [{"event_uuid": "w1", "temperature_c": 30.0, "ts": at()}])
    got = {(r.pass_id, r.weather_id) for r in jobs.current_pairs(log).collect()}
    assert got == {("p1", "w1"), ("p2", None), ("p3", "w3"), ("p4", None), ("p5", None)}


def test_fan_out(spark, tmp_path):
    root = str(tmp_path)
    land(event_rows(spark, {"event_type": C.SOIL}, {"event_type": C.WEATHER}), f"{root}/in")
    jobs.run_available(jobs.fan_out(
        stream(spark, f"{root}/in"), {"all": "true", "soil": f"event_type = '{C.SOIL}'"},
        root, f"{root}/ckpt"))
    assert spark.read.parquet(f"{root}/all").count() == 2
    assert spark.read.parquet(f"{root}/soil").count() == 1


def test_ingest_counts_and_resumes(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    records = testbed.payloads(testbed.flawed(testbed.stream_events(spark, sf_dir, [C.SOIL])))
    jobs.run_available(jobs.ingest(records, f"{root}/out", f"{root}/ckpt"))
    out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out/*/*/*")
    counters = jobs.run_counters(spark, f"{root}/out")
    assert counters["fetched"] == out.count() == records_in(spark, sf_dir)
    assert counters["messages_sent"] == out.filter("outcome = 'accepted'").count() > 0
    jobs.run_available(jobs.ingest(records, f"{root}/out", f"{root}/ckpt"))
    assert jobs.run_counters(spark, f"{root}/out", after=0)["fetched"] == 0
    assert jobs.run_counters(spark, f"{root}/out") == counters


def records_in(spark, sf_dir):
    return testbed.events(spark, sf_dir, [C.SOIL]).count()


def test_counters_of_many_batches(spark, sf_dir, tmp_path):
    root = str(tmp_path)
    rows = testbed.payloads(testbed.events(spark, sf_dir, [C.SOIL])).limit(120)
    rows.repartition(110).write.parquet(f"{root}/in")
    landed = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    jobs.run_available(jobs.ingest(landed, f"{root}/out", f"{root}/ckpt"))
    assert jobs.run_counters(spark, f"{root}/out")["fetched"] == 120


def test_last_reading_survives_later_gaps(spark, tmp_path):
    root = str(tmp_path)
    log = ChangeLog(spark, f"{root}/log", ["plot_id"],
                    "plot_id string, last_ndvi double, last_ts timestamp")
    for i, ndvi in enumerate([0.3, None]):
        land(event_rows(spark, {"event_uuid": str(i), "ndvi": ndvi, "ts": at(i)}), f"{root}/in")
        latest = jobs.last_readings(stream(spark, f"{root}/in"), ["ndvi"])
        jobs.run_available(
            latest.writeStream.outputMode("update").foreachBatch(log.write)
            .option("checkpointLocation", f"{root}/ckpt"))
    row, = log.current().collect()
    assert (row.last_ndvi, row.last_ts) == (0.3, at(1))
