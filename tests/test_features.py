from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from furrow import contracts as C
from furrow.functions import spread
from furrow.operators import features, metrics, similarity
from helpers import T0, at, event_rows


def test_asof_edges(spark):
    df = event_rows(
        spark,
        {"event_uuid": "p0", "event_type": C.SATELLITE, "ts": at(-10), "ndvi": 0.4},
        {"event_uuid": "w1", "temperature_c": 30.0},
        {"event_uuid": "w2", "temperature_c": 31.0},
        {"event_uuid": "p1", "event_type": C.SATELLITE, "ndvi": 0.5},
        {"event_uuid": "p2", "event_type": C.SATELLITE, "ts": at(hours=100), "ndvi": 0.6},
        {"event_uuid": "p3", "event_type": C.SATELLITE, "plot_id": "UP_1_1", "ndvi": 0.6},
    )
    rows = {r.event_uuid: (r.weather_ts, r.temperature_c)
            for r in features.asof_weather(df).collect()}
    assert rows == {"p0": (None, None), "p1": (at(), 31.0), "p2": (at(), 31.0),
                    "p3": (None, None)}


def _busy_plot(spark):
    """One plot with most of the rows, many of them at the same instants."""
    rng = random.Random(5)
    return event_rows(spark, *[
        {"event_uuid": f"{i:05}", "event_type": rng.choice([C.WEATHER, C.SATELLITE, C.MARKET]),
         "ts": at(rng.randrange(0, 3000)), "plot_id": rng.choice(["hot"] * 9 + ["b", "c"]),
         "crop": rng.choice(["rice"] * 5 + ["wheat"]), "market_location": "Pune",
         "ndvi": 0.5, "temperature_c": float(rng.randrange(200, 400)) / 10,
         "price_per_quintal_inr": float(rng.randrange(1500, 4500))}
        for i in range(3000)
    ])


def test_ranges_do_not_change_results(spark):
    df = _busy_plot(spark).cache()
    for fn in (features.asof_weather, features.price_change):
        expected = sorted(map(str, fn(df, ranges=1).collect()))
        for ranges in (2, 7, 40, None):
            assert sorted(map(str, fn(df, ranges=ranges).collect())) == expected


def test_one_instant_spreads_over_ranges(spark):
    df = event_rows(spark, *[
        {"event_uuid": f"{i:05}", "event_type": C.SATELLITE if i % 9 else C.WEATHER, "temperature_c": float(i),
         "ts": at(0) if i > 9 else at(-i)} for i in range(1000)])
    rows = spread.ranged(df, ["plot_id", "ts", "event_uuid"], 10)
    sizes = [r["count"] for r in rows.filter(F.col("ts") == at(0)).groupBy(spread.RANGE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 300
    found = features.asof_weather(df, ranges=10).collect()
    # readings of an instant come before its passes, so the greatest id among them wins
    assert {r.temperature_c for r in found if r.ts == at(0)} == {999.0}


def test_carry_skips_ranges_without_the_value(spark):
    df = event_rows(spark, {"event_uuid": "w", "ts": at(-1), "temperature_c": 7.0}, *[
        {"event_uuid": f"{i:04}", "event_type": C.SATELLITE, "ts": at(i)} for i in range(200)])
    found = features.asof_weather(df, ranges=9).collect()
    assert len(found) == 200 and {r.temperature_c for r in found} == {7.0}


def test_price_change(spark):
    df = event_rows(spark, *[
        {"event_uuid": str(i), "event_type": C.MARKET, "crop": "rice", "market_location": "Pune",
         "ts": at(hours=30 * i), "price_per_quintal_inr": p}
        for i, p in enumerate([2000.0, 2500.0, 2000.0])])
    rows = sorted(features.price_change(df).collect())
    assert [r.change_pct for r in rows] == [None, 25.0, -20.0]


def test_rolling_mean_across_stretches(spark):
    df = event_rows(spark, *[
        {"event_uuid": str(i), "temperature_c": t, "ts": at(hours=h)}
        for i, (h, t) in enumerate([(0, 20.0), (12, 30.0), (24, 40.0), (25, 10.0), (60, 5.0)])])
    rows = sorted(features.rolling_mean(df).collect(), key=lambda r: r.ts)
    assert [r.rolling_mean for r in rows] == [20.0, 25.0, 30.0, (30 + 40 + 10) / 3, 5.0]


def test_counter_reset_is_no_negative_rate(spark):
    df = spark.createDataFrame(
        [("t", at(i), v) for i, v in enumerate([60, 120, 0, 30])],
        "topic string, ts timestamp, value long")
    rows = sorted(metrics.ingest_rate(df).collect(), key=lambda r: r.minute)
    assert [r.per_second for r in rows] == [None, 1.0, 0.0, 0.5]


def test_histogram_quantile(spark):
    df = spark.createDataFrame(
        [("x", 1.0, 50), ("x", 2.0, 90), ("x", 4.0, 100), ("x", float("inf"), 100),
         ("y", 1.0, 0), ("y", float("inf"), 10), ("z", 1.0, 0), ("z", float("inf"), 0)],
        "s string, le double, cumulative long")
    rows = {r.s: r.quantile for r in metrics.histogram_quantile(df, 0.95, ["s"]).collect()}
    assert rows == {"x": 3.0, "y": 1.0}


def test_lag_alarm(spark):
    totals = spark.createDataFrame(
        [("t", 0, at(0), 10, 10), ("t", 0, at(1), 80, None), ("t", 0, at(2), 90, None)],
        "topic string, partition int, ts timestamp, produced long, committed long")
    rows = metrics.consumer_lag(totals, ["topic", "partition"]).collect()
    assert [(r.lag, r.growth, r.alarm) for r in sorted(rows, key=lambda r: r.minute)] == [
        (0, None, False), (70, 70, True), (80, 10, False)]


def test_gauge_at_the_limit_is_quiet(spark):
    df = spark.createDataFrame([(at(0), 50), (at(6), 51)], "ts timestamp, value long")
    rows = metrics.gauge_alarm(df).collect()
    assert sorted((r.mean_value, r.alarm) for r in rows) == [(50.0, False), (51.0, True)]


def test_drift_of_equal_periods_is_nil(spark):
    df = event_rows(spark, *[
        {"event_uuid": str(i), "event_type": C.SATELLITE, "ndvi": 0.2 + (i % 30) / 50,
         "ts": at(hours=24 * (i // 300))} for i in range(600)])
    row = metrics.data_drift(
        df, F.col("ts") >= F.lit(at(hours=24)), {"ndvi": (0.2, 0.8)}).first()
    assert row.mean_before == row.mean_after and abs(row.psi) < 1e-12


def test_knn_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8))
    vectors[350:] = vectors[7]  # many copies of one vector: ties go by id
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    stored = np.asarray([r.embedding for r in df.orderBy("vec_id").collect()])
    asked = [7, 20, 33, 41, 58]
    queries = df.filter(F.col("vec_id").isin(asked)).withColumnRenamed("vec_id", "query_id")
    unit = stored / np.linalg.norm(stored, axis=1, keepdims=True)
    odd = spark.createDataFrame(
        [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0] * 3)],
        "vec_id long, embedding array<float>")
    assert {r.reason: r.n for r in similarity.unusable(odd).collect()} == {
        "null": 1, "empty": 1, "zero": 1, "not finite": 1}
    for block in (1 << 20, 512):
        monkeypatch.setattr(similarity, "BLOCK_BYTES", block)
        rows = similarity.knn(df.unionByName(odd).repartition(7), queries, 5).collect()
        got = {(r.query_id, r.rank): r.vec_id for r in rows}
        for q in asked:
            scores = unit @ unit[q]
            best = np.lexsort((np.arange(400), -np.round(scores, 9)))[:5]
            assert [got[q, i + 1] for i in range(5)] == best.tolist()


def test_knn_skips_clusters_that_cannot_matter(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 4096)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 900)] + 0.05 * rng.normal(size=(900, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = similarity.sampled_queries(df, 30)
    got = {(r.query_id, r.rank): r.vec_id for r in similarity.knn(df, queries, 4).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 900, 30):
        best = np.lexsort((np.arange(900), -np.round(unit @ unit[q], 12)))[:4]
        assert [got[q, i + 1] for i in range(4)] == best.tolist()
    share = similarity.searched_share(df, queries, 4).first()
    assert share.searched < share.pairs / 3


def test_knn_sends_copied_queries_by_a_shuffle(spark, monkeypatch):
    """Queries copied to the places of a cluster are never gathered for a broadcast, and several
    places find what one does."""
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 1024)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 8))
    x[600:900] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    queries = similarity.sampled_queries(df)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, i + 1): v for q in range(0, 1200, 50)
            for i, v in enumerate(np.lexsort((np.arange(1200), -np.round(unit @ unit[q], 12)))[:3].tolist())}
    for blocks in (1, 32):
        monkeypatch.setattr(similarity, "PLACE_BLOCKS", blocks, raising=False)
        found = similarity.knn(df, queries, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [dim" in plan
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "place#" in line]
        assert {(r.query_id, r.rank): r.vec_id for r in found.collect()} == want


def test_knn_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    none = df.filter("false").withColumnRenamed("vec_id", "query_id")
    assert similarity.knn(df, none).count() == 0


def test_knn_with_text_ids(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])],
                               "vec_id string, embedding array<float>")
    rows = similarity.knn(df, df.withColumnRenamed("vec_id", "query_id"), 2).collect()
    assert {(r.query_id, r.rank): r.vec_id for r in rows} == {
        ("a", 1): "a", ("a", 2): "b", ("b", 1): "a", ("b", 2): "b", ("c", 1): "c", ("c", 2): "a"}


def test_lag_of_uuid_events(spark):
    df = event_rows(spark, {"event_uuid": "8f14e45f-ceea-467f-a8f2-1d3c5f0e9b11"}, {"event_uuid": "7"})
    assert metrics.partition_totals(df, F.lit(True)).count() == 2


def test_windowed_join_keeps_both_sides(spark):
    df = event_rows(
        spark, {"temperature_c": 30.0}, {"event_type": C.SATELLITE, "ndvi": 0.4, "ts": at(hours=3)},
        {"event_type": C.MARKET, "plot_id": None, "crop": "rice",
         "price_per_quintal_inr": 2000.0}).withColumn("precipitation_mm", F.lit(1.0))
    plots = spark.createDataFrame([("WB_123_45", "rice")], "plot_id string, crop_type string")
    rows = sorted(features.windowed_join(df, plots).collect(), key=lambda r: r.hour)
    assert [(r.hour, r.air_temp, r.ndvi, r.price) for r in rows] == [
        (T0, 30.0, None, 2000.0), (at(hours=3), None, 0.4, 2000.0)]
