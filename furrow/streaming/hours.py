"""Plot-hours with a timer each: summed once, closed once, late readings set aside.

The engine's own windowed aggregate drops what comes after an hour was closed. Here the plots of an
hour are dealt to a few buckets; a bucket of an hour is a key, with the sums of its plots as state and
a timer at the hour's end. When the watermark passes it, the sums go out as `closed` and the state is
dropped; readings of that hour that come later go out as `late`. Every reading is in exactly one of
the two, so `closed` alone serves alerts that are raised once, and both together give the sums of all
readings. Calls of state and timers cost far more than sums: they grow with the hours that a batch
touches, not with their plots.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from furrow import contracts as C
from furrow.functions import exact
from furrow.operators import alerts
from furrow.streaming import jobs

HOUR_MS = 3_600_000
#: States and timers of an hour, at most; fixed with a query's first start. A task holds the plots of
#: one bucket of one hour at a time.
BUCKETS = 32
_PARTS = [f"{part}_{m}" for m in alerts.METRICS for part in ("sum", "n")]
_PARTS_DDL = ", ".join(f"{p} {exact.EXACT if p.startswith('sum') else 'bigint'}" for p in _PARTS)
_KEYED_DDL = f"plot_id string, start_ms bigint, {_PARTS_DDL}"
_OUT_DDL = f"kind string, {_KEYED_DDL}"
_OUT = Row("kind", "plot_id", "start_ms", *_PARTS)
_STATE_DDL = "plot_id array<string>, " + ", ".join(
    f"{p} array<{exact.EXACT if p.startswith('sum') else 'bigint'}>" for p in _PARTS)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's sums per plot-hour, so that a busy plot sends few rows to its state."""
    for batch in batches:
        if batch.num_rows:
            summed = pa.Table.from_batches([batch]).group_by(["plot_id", "start_ms"]).aggregate(
                [(m, how) for m in alerts.METRICS for how in ("sum", "count")])
            arrays = [summed[c] for c in ("plot_id", "start_ms")]
            for m in alerts.METRICS:
                arrays += [summed[f"{m}_sum"].cast(pa.decimal128(38, 18)), summed[f"{m}_count"]]
            yield from pa.Table.from_arrays(arrays, ["plot_id", "start_ms", *_PARTS]).to_batches()


def _plus(a: tuple, b: tuple) -> tuple:
    return tuple(y if x is None else x if y is None else x + y for x, y in zip(a, b))


class _Hours(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", _STATE_DDL)

    def _held(self) -> dict[str, tuple]:
        """The open sums of a bucket, by plot."""
        state = self.sums.get()
        return {plot: parts for plot, *parts in zip(*state, strict=True)} if state else {}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = {}
        for plot, *parts in ((row[name] for name in ("plot_id", *_PARTS)) for row in rows):
            fresh[plot] = _plus(fresh[plot], parts) if plot in fresh else parts
        start, held = key[0], self._held()
        if start + HOUR_MS <= timerValues.getCurrentWatermarkInMs():
            for plot in fresh.keys() - held.keys():
                yield _OUT("late", plot, start, *fresh.pop(plot))
        elif not held:
            self.handle.registerTimer(start + HOUR_MS)
        if fresh:
            for plot, parts in fresh.items():
                held[plot] = _plus(held[plot], parts) if plot in held else parts
            self.sums.update((list(held), *map(list, zip(*held.values(), strict=True))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._held()
        self.sums.clear()
        for plot, parts in held.items():
            yield _OUT("closed", plot, key[0], *parts)

    def close(self) -> None:
        pass


def hour_stream(*streams: DataFrame, delay: str = C.WATERMARK_DELAY) -> DataFrame:
    """kind (closed or late), plot_id, window_start, window_end and the sums of `alerts.METRICS`, for
    an append sink: a row per closed plot-hour, and a row per batch and plot-hour that came late.

    Rows without a time belong to no hour and are left out, as in `alerts.hourly_sums`. A plot-hour
    that has state takes readings until its timer fires, so what comes in the very batch that closes
    it still counts. State is one sum per open plot-hour, whatever the history.
    """
    marked = jobs.union_sources(*streams, delay=delay).filter(F.col("ts").isNotNull())
    parts = marked.select(
        F.coalesce("plot_id", F.lit(C.UNKNOWN_PLOT)).alias("plot_id"),
        (F.floor(F.unix_seconds("ts") / F.lit(3600)) * HOUR_MS).cast("long").alias("start_ms"),
        *[exact.units(F.col(r)).alias(m) for m, r in alerts.METRICS.items()],
    ).mapInArrow(_partial, _KEYED_DDL).withColumn("bucket", F.pmod(F.xxhash64("plot_id"), F.lit(BUCKETS)))
    found = parts.groupBy("start_ms", "bucket").transformWithState(
        _Hours(), outputStructType=_OUT_DDL, outputMode="Append", timeMode="EventTime")
    return found.select(
        "kind", "plot_id", F.timestamp_millis("start_ms").alias("window_start"),
        F.timestamp_millis(F.col("start_ms") + HOUR_MS).alias("window_end"), *_PARTS)


def alerts_of(hours: DataFrame) -> DataFrame:
    """Alerts of the closed hours among what `hour_stream` gave, each raised once."""
    return alerts.alerts_from(alerts.averages(hours.filter("kind = 'closed'")))


def corrected(hours: DataFrame) -> DataFrame:
    """Means per plot-hour with the late readings put back."""
    return alerts.averages(alerts.added(hours.withColumn("batch_id", F.lit(0))))
