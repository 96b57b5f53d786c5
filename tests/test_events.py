from __future__ import annotations

import json

from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.operators import events
from furrow.sources import io
from helpers import at, event_rows


def records(spark, *values):
    return spark.createDataFrame(
        [(v, str(i)) for i, v in enumerate(values)], "value string, record_id string")


def test_decode_and_poison(spark):
    good = {"event_uuid": "u", "event_type": C.SATELLITE, "timestamp": "2024-01-01T10:00:00",
            "plot_id": "WB_123_45", "data": {"ndvi": 0.4, "new_key": 1}, "metadata": {}}
    df = records(spark, "not json", "{bad", "{}", json.dumps(good), None, "[]",
                 '{"event_uuid": "x", "data": {"ndvi": "green"}}')
    rows = events.decode(df).collect()
    assert [(r.event_uuid, r.ndvi, r.ts) for r in rows] == [(None, None, None), ("u", 0.4, at())]
    bad = {r.record_id: r.bad_record for r in events.poison(df).collect()}
    assert set(bad) == {"0", "1", "4", "5", "6"} and bad["1"] == "{bad" and bad["4"] == ""


def test_unparsable_time_is_null(spark):
    row = events.decode(records(spark, '{"timestamp": "soon"}')).first()
    assert row.ts is None


def test_topics(spark):
    df = event_rows(spark, {"event_type": C.SOIL}, {"event_type": "other"},
                    {"event_type": C.MARKET, "plot_id": None, "crop": "rice"})
    rows = events.to_topic_records(df).collect()
    assert [(r.topic, r.key) for r in rows] == [
        ("agri.iot.raw", "WB_123_45"), ("agri.misc.raw", "WB_123_45"), ("agri.market.raw", "rice")]
    assert json.loads(rows[0].value)["ts"] == "2024-01-01T10:00:00.000000"


def test_dedup_keeps_the_newest_and_tells_plots_apart(spark):
    df = event_rows(
        spark, {"event_uuid": "a", "ndvi": 0.1}, {"event_uuid": "a", "ndvi": 0.2, "ts": at(1)},
        {"event_uuid": "a", "plot_id": "UP_1_1"}, {"event_uuid": "m", "plot_id": None},
        {"event_uuid": "m", "plot_id": None})
    once = events.deduplicate(df)
    assert sorted((r.event_uuid, r.plot_id or "", r.ndvi) for r in once.collect()) == [
        ("a", "UP_1_1", None), ("a", "WB_123_45", 0.2), ("m", "", None)]
    assert events.deduplicate(once).count() == once.count()


def test_upsert_is_idempotent_and_ignores_older(spark):
    old = event_rows(spark, {"event_uuid": "a", "ndvi": 0.1, "ts": at(5)})
    new = event_rows(spark, {"event_uuid": "a", "ndvi": 0.9, "ts": at(1)},
                     {"event_uuid": "b", "ndvi": 0.3})
    merged = events.upsert(old, new, events.EVENT_KEY, F.struct("ts"))
    again = events.upsert(merged, new, events.EVENT_KEY, F.struct("ts"))
    assert sorted((r.event_uuid, r.ndvi) for r in again.collect()) == [("a", 0.1), ("b", 0.3)]


def test_insert_new(spark):
    stored = event_rows(spark, {"event_uuid": "a"}, {"event_uuid": "m", "plot_id": None})
    arriving = event_rows(spark, {"event_uuid": "a"}, {"event_uuid": "m", "plot_id": None},
                          {"event_uuid": "b"}, {"event_uuid": "b"},
                          {"event_uuid": "a", "plot_id": "UP_1_1"})
    rows = events.insert_new(stored, arriving, events.EVENT_KEY).collect()
    assert sorted((r.event_uuid, r.plot_id) for r in rows) == [
        ("a", "UP_1_1"), ("b", "WB_123_45")]


def test_orders(spark):
    df = event_rows(spark, *[
        {"event_uuid": f"{i:03}", "ts": at(i * 7 % 50), "plot_id": f"P{i % 3}"}
        for i in range(100)])
    times = [(r.ts, r.event_uuid) for r in events.sort_by_time(df).collect()]
    assert times == sorted(times)
    laid_out = [(r.plot_id, r.ts, r.event_uuid) for r in events.order_per_plot(df).collect()]
    assert laid_out == sorted(laid_out)


def test_union_is_a_bag(spark):
    a = event_rows(spark, {"event_uuid": "a"}).select("event_uuid", "ts")
    b = event_rows(spark, {"event_uuid": "a"}).select("event_uuid", "ndvi")
    assert events.union_all(a, b, b).count() == 3


def test_plot_ids(spark):
    df = spark.createDataFrame(
        [("WB_123_45",), ("wb_123_45",), ("XX_123_4",), ("WB_12",), (None,)], "plot_id string")
    rows = events.parse_plot_id(df).collect()
    assert [(r.well_formed, r.known_state, r.block_no) for r in rows] == [
        (True, True, 123), (False, False, 123), (True, False, 123), (False, True, 12),
        (False, False, None)]


def test_json_array_file(spark, tmp_path):
    body = [{"event_uuid": "a", "event_type": C.WEATHER, "timestamp": "2024-01-01T10:00:00",
             "plot_id": "P", "data": {"temperature_c": 31.5,
                                      "forecast_3d": {"temp_max": 35.0}}, "metadata": {}}]
    (tmp_path / "events.json").write_text(json.dumps(body, indent=2))
    row = io.read_json_array(spark, str(tmp_path / "events.json")).first()
    assert row.data.temperature_c == 31.5 and row.data.forecast_3d.temp_max == 35.0


def test_lake_reads_only_the_wanted_folders(spark, tmp_path):
    path = str(tmp_path / "lake")
    io.write_lake(event_rows(spark, {"event_type": C.SOIL}, {"event_type": C.SATELLITE},
                             {"event_type": C.SOIL, "ts": at(hours=24)}), path)
    soil = io.read_lake(spark, path, C.SOIL)
    assert soil.count() == 2
    plan = soil._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan or "event_type#" in plan.split(
        "PartitionFilters")[1].split("]")[0]
