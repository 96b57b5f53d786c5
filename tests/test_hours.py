from __future__ import annotations

import time

from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.operators import alerts
from furrow.streaming import hours, jobs, progress
from helpers import EVENT_DDL, at, event_rows


def run(spark, root, *rows):
    event_rows(spark, *rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(EVENT_DDL).parquet(f"{root}/in")
    return jobs.run_available(jobs.append_files(
        hours.hour_stream(source), f"{root}/out", f"{root}/ckpt", "kind"))


def test_hours_close_once_and_late_readings_are_kept(spark, tmp_path):
    root = str(tmp_path)
    batches = [
        [{"ts": at(5), "temperature_c": 39.0}, {"ts": at(10), "temperature_c": 41.0},
         {"ts": at(10), "plot_id": None, "ndvi": 0.1}, {"ts": None, "ndvi": 0.9}],
        [{"ts": at(50), "temperature_c": 40.0}, {"ts": at(hours=3), "temperature_c": 20.0}],
        [{"ts": at(20), "temperature_c": 0.0}, {"ts": at(20), "temperature_c": 1.0},
         {"ts": at(hours=2), "plot_id": "quiet", "ndvi": 0.25}],
        [{"ts": at(hours=30)}],
        [{"ts": at(30), "temperature_c": 2.0}],
    ]
    for rows in batches:
        query = run(spark, root, *rows)
    out = spark.read.parquet(f"{root}/out")
    closed = {(r.plot_id, r.window_start): r for r in out.filter("kind = 'closed'").collect()}
    assert out.filter("kind = 'closed'").count() == len(closed)
    first = closed["WB_123_45", at()]
    assert (float(first.sum_temp), first.n_temp, first.sum_ndvi, first.n_ndvi) == (120.0, 3, None, 0)
    assert closed[C.UNKNOWN_PLOT, at()].n_ndvi == closed["quiet", at(hours=2)].n_ndvi == 1
    late = sorted((r.plot_id, float(r.sum_temp), r.n_temp) for r in out.filter("kind = 'late'").collect())
    assert late == [("WB_123_45", 1.0, 2), ("WB_123_45", 2.0, 1)]
    raised = [(r.plot_id, r.alert_type, r.window_end) for r in hours.alerts_of(out).collect()]
    assert sorted(raised) == sorted([
        ("WB_123_45", C.HEAT_ALERT[0], at(hours=1)), ("quiet", C.NDVI_ALERT[0], at(hours=3)),
        (C.UNKNOWN_PLOT, C.NDVI_ALERT[0], at(hours=1))])
    # the hour that holds the newest reading is all the state there is
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 3

    # every reading is in one of both: with the late ones put back, means are those of a batch
    rows = event_rows(spark, *[r for b in batches for r in b]).filter(F.col("ts") < at(hours=30))
    columns = ["plot_id", "window_start", "n_ndvi", "n_temp", "avg_ndvi", "avg_temp"]
    assert sorted(map(str, hours.corrected(out).select(columns).collect())) == \
        sorted(map(str, alerts.hourly_metrics(rows).select(columns).collect()))


def test_plots_of_an_hour_share_state_and_timer(spark, tmp_path, monkeypatch):
    """State grows with the open hours, not with their plots; still each plot closes on its own."""
    monkeypatch.setattr(hours, "BUCKETS", 1, raising=False)
    root = str(tmp_path)
    for rows in ([{"ts": at(5), "plot_id": f"p{k}", "temperature_c": float(k)} for k in range(200)],
                 [{"ts": at(hours=3)}],
                 [{"ts": at(9), "plot_id": "p7", "temperature_c": 0.5}, {"ts": at(9), "plot_id": "new", "temperature_c": 2.0}]):
        event_rows(spark, *rows).coalesce(1).write.mode("append").parquet(f"{root}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    source = spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    query = jobs.run_available(jobs.append_files(hours.hour_stream(source), f"{root}/out", f"{root}/ckpt", "kind"))
    assert max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 6
    out = {(r.kind, r.plot_id): (float(r.sum_temp), r.n_temp) for r in spark.read.parquet(f"{root}/out").collect()}
    assert out == {**{("closed", f"p{k}"): (float(k), 1) for k in range(200)},
                   ("closed", "p7"): (7.5, 2), ("late", "new"): (2.0, 1)}


def test_listener_counts_batches(spark, tmp_path):
    root = str(tmp_path)
    for n in (3, 5):
        event_rows(spark, *[{}] * n).coalesce(1).write.mode("append").parquet(f"{root}/in")
    source = spark.readStream.schema(EVENT_DDL).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    seen = progress.ProgressLog(keep=1)
    spark.streams.addListener(seen)
    try:
        query = jobs.run_available(progress.files_taken(source, f"{root}/taken", f"{root}/ckpt"))
        row, = seen.wait(spark, str(query.id)).collect()
    finally:
        spark.streams.removeListener(seen)
    assert (row.batch_id, row.input_rows, seen.started, seen.ended, seen.failed) == (1, 5, 1, 1, 0)
    assert [r.rows for r in spark.read.parquet(f"{root}/taken").orderBy("batch_id").collect()] == [3, 5]


def test_continuous_trigger(spark, tmp_path):
    """The deployment's form: a batch at once, then one per trigger interval, until it is stopped."""
    root = str(tmp_path)
    event_rows(spark, {}, {}).write.parquet(f"{root}/in")
    query = jobs.run_continuously(progress.files_taken(
        spark.readStream.schema(EVENT_DDL).parquet(f"{root}/in"), f"{root}/taken", f"{root}/ckpt"))
    try:
        for _ in range(600):
            if query.lastProgress:
                break
            time.sleep(0.1)
        assert query.isActive and query.lastProgress.batchId == 0
    finally:
        query.stop()
    assert spark.read.parquet(f"{root}/taken").agg(F.sum("rows")).first()[0] == 2
