"""Keyed tables: results, and what a batch reads and rewrites."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from furrow.operators import events
from furrow.streaming import keyed
from furrow.streaming.keyed import InsertLog, UpsertTable
from helpers import EVENT_DDL, at, event_rows

KEY = events.EVENT_KEY


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def many(spark, ids, **more):
    return event_rows(spark, *[{"event_uuid": f"e{i}", **more} for i in ids])


def test_upsert_rewrites_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    table = UpsertTable(spark, root, KEY, EVENT_DDL, ["ts"], buckets=16)
    table.upsert(many(spark, range(300), ndvi=0.1))
    before = files(root)
    small = many(spark, [3, 4], ndvi=0.9, ts=at(5)).unionByName(many(spark, [5], ndvi=0.0, ts=at(-5)))
    touched = table.upsert(small)
    after = files(root)
    assert 1 <= len(touched) <= 3
    kept = [p for p in before if not any(f"_bucket={b}{os.sep}" in p for b in touched)]
    assert kept and all(after.get(p) == before[p] for p in kept)
    assert all(p not in after for p in before if p not in kept)
    got = {r.event_uuid: r.ndvi for r in table.current().collect()}
    assert len(got) == 300 and (got["e3"], got["e4"], got["e5"], got["e6"]) == (0.9, 0.9, 0.1, 0.1)
    state = sorted(map(str, table.current().collect()))
    table.upsert(small)
    assert sorted(map(str, table.current().collect())) == state


def test_upsert_equals_the_plain_merge(spark, tmp_path):
    old = many(spark, range(50), ts=at(1)).unionByName(event_rows(spark, {"event_uuid": None, "plot_id": None}))
    new = many(spark, range(40, 70), ts=at(2), ndvi=1.0).unionByName(
        event_rows(spark, {"event_uuid": None, "plot_id": None, "ts": at(9)}, {"event_uuid": "e1", "plot_id": None}))
    table = UpsertTable(spark, str(tmp_path / "t"), KEY, EVENT_DDL, ["ts"], buckets=5)
    assert table.current().count() == 0 and table.upsert(old.limit(0)) == []
    table.upsert(old)
    table.upsert(new)
    plain = events.upsert(old, new, KEY, F.struct("ts"))
    assert sorted(map(str, table.current().collect())) == sorted(map(str, plain.collect()))


def test_insert_reads_only_buckets_with_possible_copies(spark, tmp_path):
    log = InsertLog(spark, str(tmp_path / "l"), KEY, EVENT_DDL, buckets=32)
    assert log.insert(many(spark, range(200)), 0) == []
    assert log.insert(many(spark, range(200, 400)), 1) == []
    read = log.insert(many(spark, [7, 399, 500]), 2)
    assert 1 <= len(read) <= 2
    known = log.rows(2, read)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*_bucket", plan)
    paths = [r[0] for r in known.select(F.input_file_name()).distinct().collect()]
    assert paths and all(any(f"_bucket={b}/" in p for b in read) for p in paths)
    assert sorted(r.event_uuid for r in log.rows().filter("batch_id = 2").collect()) == ["e500"]
    assert log.rows().count() == 401


def test_insert_run_again_and_null_keys(spark, tmp_path):
    log = InsertLog(spark, str(tmp_path / "l"), KEY, EVENT_DDL, buckets=4)
    batch = event_rows(spark, {"event_uuid": "a", "plot_id": None, "ts": at(2)}, {"event_uuid": "a", "plot_id": None},
                       {"event_uuid": None}, {"event_uuid": "a"})
    log.insert(batch, 0)
    log.insert(batch, 0)
    assert log.rows().count() == 3
    log.insert(batch.unionByName(event_rows(spark, {"event_uuid": "b"})), 1)
    assert log.rows().count() == 4
    first, = log.rows().filter("event_uuid = 'a' AND plot_id IS NULL").collect()
    assert first.ts == at(0)


def test_later_batches_read_no_more_folders(spark, tmp_path):
    log = InsertLog(spark, str(tmp_path / "l"), KEY, EVENT_DDL, buckets=8)
    read = [len(log.insert(many(spark, [*range(20 * i, 20 * i + 20), max(20 * i - 1, 0)]), i)) for i in range(6)]
    assert read == [0, 1, 1, 1, 1, 1]
    assert log.rows().count() == 120


def test_filter_holds_every_key_and_few_others(spark):
    own = keyed.filter_words(spark.range(2000).select(F.col("id").cast("string").alias("k")), ["k"])
    held = own.groupBy("word").agg(F.bit_or("bits").alias("held"))
    asked = keyed.filter_words(spark.range(1000, 4000).select(F.col("id").cast("string").alias("k")), ["k"])
    hits = asked.join(held, "word").filter(F.col("held").bitwiseAND(F.col("bits")) != 0) \
        .groupBy("k").count().filter(F.col("count") >= keyed.HASHES)
    found = {int(r.k) for r in hits.collect()}
    assert set(range(1000, 2000)) <= found and len(found) <= 1010
