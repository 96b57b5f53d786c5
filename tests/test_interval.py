from __future__ import annotations

from furrow.streaming import interval
from helpers import EVENT_DDL, at, event_rows


def test_engine_join_in_any_order(spark, tmp_path):
    root = str(tmp_path)
    join = interval.IntervalJoin(spark, f"{root}/join")

    def run(passes, readings):
        for name, rows in (("sat", passes), ("rain", readings)):
            event_rows(spark, *rows).coalesce(1).write.mode("append").parquet(f"{root}/{name}")
        return join.run(*(spark.readStream.schema(EVENT_DDL).parquet(f"{root}/{n}") for n in ("sat", "rain")))

    def got():
        return {(r.pass_id, r.weather_id) for r in join.pairs().collect()}

    run([{"event_uuid": "p3", "ts": at(hours=72)}], [{"event_uuid": "w3", "ts": at(hours=72)}])
    # days before the rows above, a pass before its reading, rows that can't be placed
    run([{"event_uuid": "p1", "ts": at(hours=6)}, {"event_uuid": "p2", "ts": at(hours=14)},
         {"event_uuid": "p4", "ts": at(hours=72), "plot_id": None}, {"event_uuid": "p6", "ts": None},
         {"event_uuid": "p7", "ts": at(hours=79)}],
        [{"event_uuid": "w2", "ts": at(hours=7)}, {"event_uuid": "w4", "ts": at(hours=76), "plot_id": None}])
    assert ("p7", None) not in got()
    run([{"event_uuid": "p5", "ts": at(hours=100)}], [{"event_uuid": "w1", "ts": at()},
                                                       {"event_uuid": "w5", "ts": at(hours=90)}])
    want = {("p1", "w1"), ("p2", None), ("p3", "w3"), ("p4", None), ("p6", None), ("p7", None)}
    assert got() == want
    # a late reading takes the place of the empty row of a punctual pass
    run([], [{"event_uuid": "w6", "ts": at(hours=78)}, {"event_uuid": "w7", "ts": at(hours=102)}])
    query = run([{"event_uuid": "p8", "ts": at(hours=500)}], [{"event_uuid": "w8", "ts": at(hours=494)}])
    assert got() == want - {("p7", None)} | {("p7", "w6"), ("p5", None), ("p8", "w8")}
    assert join.pairs().count() == len(got())
    op = query.lastProgress.stateOperators[0]
    assert op.numRowsDroppedByWatermark == 0 and op.numRowsTotal <= 4


def test_engine_join_without_rows(spark, tmp_path):
    root = str(tmp_path)
    for name in ("sat", "rain"):
        event_rows(spark).coalesce(1).write.parquet(f"{root}/{name}")
    join = interval.IntervalJoin(spark, f"{root}/join")
    join.run(*(spark.readStream.schema(EVENT_DDL).parquet(f"{root}/{n}") for n in ("sat", "rain")))
    assert join.pairs().count() == 0
