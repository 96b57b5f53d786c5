"""Passes with the readings of the hours before them, joined in the engine's own state.

1. Each side is judged on arrival: a row older than the newest one of earlier batches by more than
   the delay is set aside, the others are punctual. Both are kept below the shared folder, by day.
2. Punctual rows of both sides meet in a stream-stream left outer join. Its watermarks have the same
   delay, so it drops none of them, and its state holds the delay and the look-back, not history.
3. What was set aside is joined in a batch with the rows of the days it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from furrow import contracts as C
from furrow.streaming import jobs
from furrow.streaming.changelog import ChangeLog

PASSES, READINGS = "passes", "readings"
_SIDES = {
    PASSES: {"pass_id": "event_uuid", "plot_id": "plot_id", "pass_ts": "ts", "ndvi": "ndvi"},
    READINGS: {"weather_id": "event_uuid", "w_plot": "plot_id", "weather_ts": "ts",
               "temperature_c": "temperature_c"},
}
_DDL = {
    PASSES: "pass_id string, plot_id string, pass_ts timestamp, ndvi double",
    READINGS: "weather_id string, w_plot string, weather_ts timestamp, temperature_c double",
}
_TIME = {PASSES: "pass_ts", READINGS: "weather_ts"}
PAIR = ["pass_id", "plot_id", "pass_ts", "ndvi", "weather_id", "weather_ts", "temperature_c"]


class IntervalJoin:
    """All files lie below `root`. `delay` bounds how long a row is waited for in the join."""

    def __init__(self, spark: SparkSession, root: str, delay: str = C.WATERMARK_DELAY,
                 hours: int = C.JOIN_LOOKBACK_HOURS):
        self.spark, self.root, self.delay, self.hours = spark, root.rstrip("/"), delay, hours
        self.newest = {side: ChangeLog(spark, f"{self.root}/newest-{side}", ["side"],
                                       "side string, newest timestamp", version=["newest"])
                       for side in _SIDES}

    def _split(self, side: str, stream: DataFrame) -> None:
        """Rows without a plot or a time meet nothing and would wait for ever: set aside as well."""
        log, time = self.newest[side], _TIME[side]
        rows = stream.select(*[F.col(c).alias(name) for name, c in _SIDES[side].items()])
        plot = "plot_id" if side == PASSES else "w_plot"

        def write(batch: DataFrame, batch_id: int) -> None:
            known = F.broadcast(log.current(before=batch_id))  # a single row
            punctual = F.col(plot).isNotNull() & F.col(time).isNotNull() & (
                F.col("newest").isNull() | (F.col(time) >= F.col("newest") - F.expr(f"interval {self.delay}")))
            out = f"{self.root}/{side}/batch_id={batch_id}"
            batch.withColumn("side", F.lit(side)).join(known, "side", "left").withColumns(
                {"aside": ~punctual, "day": F.to_date(time)}).drop("side", "newest") \
                .write.mode("overwrite").partitionBy("aside", "day").parquet(out)
            log.write(self._read(side, f"batch_id={batch_id}").groupBy(F.lit(side).alias("side")).agg(
                F.max(time).alias("newest")).filter("newest IS NOT NULL"), batch_id)

        jobs.run_available(rows.writeStream.foreachBatch(write).option(
            "checkpointLocation", f"{self.root}/checkpoint-{side}"))

    def _read(self, side: str, below: str = "*") -> DataFrame:
        return self.spark.read.schema(f"{_DDL[side]}, aside boolean, day date").option(
            "basePath", f"{self.root}/{side}").parquet(f"{self.root}/{side}/{below}")

    def _stretch(self, time: str) -> Column:
        return F.floor(F.unix_seconds(time) / F.lit(self.hours * 3600)).cast("bigint")

    def _joined(self, passes: DataFrame, readings: DataFrame, how: str) -> DataFrame:
        """A plot is spread over stretches as long as the look-back; a reading counts in its own and
        in the next one."""
        left = passes.withColumn("stretch", self._stretch("pass_ts"))
        own = self._stretch("weather_ts")
        right = readings.withColumn("w_stretch", F.explode(F.array(own, own + 1)))
        return left.join(right, F.expr(
            "plot_id = w_plot AND stretch = w_stretch AND weather_ts <= pass_ts "
            f"AND weather_ts >= pass_ts - interval {self.hours} hours"), how).select(*PAIR)

    def run(self, passes: DataFrame, readings: DataFrame) -> StreamingQuery:
        """Take in what there is of both sides; gives the ended query of the join."""
        for side, stream in ((PASSES, passes), (READINGS, readings)):
            self._split(side, stream)
        sides = [
            self.spark.readStream.schema(_DDL[side]).parquet(f"{self.root}/{side}/*/aside=false/*")
            .withWatermark(_TIME[side], self.delay) for side in (PASSES, READINGS)]
        return jobs.run_available(jobs.append_files(
            self._joined(*sides, "left_outer"), f"{self.root}/pairs", f"{self.root}/checkpoint-pairs"))

    def pairs(self) -> DataFrame:
        """A row per pass and reading; a pass without a reading has one row. Punctual passes appear
        with their first reading, or, without one, when the watermark has gone past them."""
        joined = self.spark.read.schema(
            f"{_DDL[PASSES]}, weather_id string, weather_ts timestamp, temperature_c double") \
            .parquet(f"{self.root}/pairs")
        rows = {side: self._read(side) for side in _SIDES}
        aside = {side: r.filter("aside").drop("aside") for side, r in rows.items()}
        # days on which what was set aside can meet the other side
        back = -(-self.hours // 24)
        days = {
            READINGS: aside[PASSES].select(F.explode(F.array(
                *[F.date_sub("day", n) for n in range(back + 1)])).alias("day")).distinct(),
            PASSES: aside[READINGS].select(F.explode(F.array(
                *[F.date_add("day", n) for n in range(back + 1)])).alias("day")).distinct(),
        }
        late = self._joined(aside[PASSES].drop("day"), rows[READINGS].join(days[READINGS], "day", "left_semi")
                            .drop("aside", "day"), "left")
        punctual = rows[PASSES].filter("NOT aside").join(days[PASSES], "day", "left_semi")
        more = self._joined(punctual.drop("aside", "day"), aside[READINGS].drop("day"), "inner")
        found = more.select("pass_id").distinct()
        bare = joined.filter("weather_id IS NULL").join(found, "pass_id", "left_anti")
        return joined.filter("weather_id IS NOT NULL").unionByName(bare).unionByName(late).unionByName(more)
