"""Structured Streaming jobs.

Every job takes streaming DataFrames and returns a writer or runs a query to the end of what is
available; the source (broker or files) is chosen outside. A scheduler starts the available-now
runs of batch ingestion, a long-running deployment uses the processing-time trigger.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from furrow import contracts as C
from furrow.functions import exact, text
from furrow.operators import alerts, events, quality
from furrow.streaming.changelog import ChangeLog
from furrow.streaming.keyed import InsertLog

SUMS_DDL = (
    "plot_id string, window_start timestamp, window_end timestamp, "
    + ", ".join(f"sum_{m} {exact.EXACT}, n_{m} bigint" for m in alerts.METRICS)
)
ALERTS_DDL = (
    "plot_id string, window_end timestamp, "
    "raised array<struct<alert_type: string, severity: string, message: string>>"
)


def metric_log(spark: SparkSession, path: str) -> ChangeLog:
    """Hourly sums, a row per plot, hour and batch, added up on reading and in compaction."""
    return ChangeLog(spark, path, ["plot_id", "window_start"], SUMS_DDL, merge=alerts.added)


def alert_log(spark: SparkSession, path: str) -> ChangeLog:
    """The alerts of each plot and hour as of the last batch that touched it."""
    return ChangeLog(spark, path, ["plot_id", "window_end"], ALERTS_DDL)


@contextmanager
def _state_partitions(n: int | None):
    """Number of state partitions of the query started inside: by default one per core of the
    cluster. It is fixed with a query's first start and, unlike a batch shuffle, cannot be
    coalesced later, so the setting for batches does not suit it."""
    spark = SparkSession.active()
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_available(writer: DataStreamWriter, state_partitions: int | None = None) -> StreamingQuery:
    """Process all there is, then stop; what a scheduled increment does."""
    with _state_partitions(state_partitions):
        query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_continuously(writer: DataStreamWriter,
                     state_partitions: int | None = None) -> StreamingQuery:
    with _state_partitions(state_partitions):
        return writer.trigger(processingTime=C.CHECKPOINT_EVERY).start()


def append_files(stream: DataFrame, path: str, checkpoint: str, *partitions: str):
    writer = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return writer.partitionBy(*partitions) if partitions else writer


def union_sources(*streams: DataFrame, delay: str = C.WATERMARK_DELAY) -> DataFrame:
    """One stream out of several, each with its own watermark before they are joined, so that
    event time follows the slowest. A source without data holds it back."""
    marked = [s.withWatermark("ts", delay) for s in streams]
    return events.union_all(*marked)


def metric_stream(*streams: DataFrame, delay: str = C.WATERMARK_DELAY) -> DataFrame:
    """Hourly metrics of the union. State is a sum and a count per reading and open window."""
    return alerts.hourly_metrics(union_sources(*streams, delay=delay))


def closed_alerts(*streams: DataFrame, delay: str = C.WATERMARK_DELAY) -> DataFrame:
    """Alerts of the windows the watermark has closed, for an append sink: each is raised once."""
    return alerts.alerts_from(metric_stream(*streams, delay=delay))


def metric_updates(streams: list[DataFrame], log: ChangeLog, checkpoint: str,
                   sink: ChangeLog | None = None) -> DataStreamWriter:
    """Sums of all windows, kept up to date in a change log (`metric_log`), however late, and in
    whatever order, readings come: a batch logs what it adds, and nothing is held in state.

    With a `sink` (`alert_log`) the alerts of the hours a batch touched are judged again and
    logged: one appears with the first readings that call for it and vanishes when others in the
    same hour bring the mean back.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(alerts.hourly_sums(batch), batch_id)
        if sink:
            hour = ["plot_id", "window_start"]
            touched = batch.sparkSession.read.schema(SUMS_DDL).parquet(
                f"{log.path}/changes/batch_id={batch_id}").select(*hour)
            sums = log.current(before=batch_id + 1).join(touched, hour, "left_semi")
            sink.write(alerts.raised(alerts.averages(sums)), batch_id)

    return events.union_all(*streams).writeStream.foreachBatch(write).option(
        "checkpointLocation", checkpoint)


def current_alerts(sink: ChangeLog) -> DataFrame:
    return sink.current().select("plot_id", "window_end", F.inline("raised"))


def first_arrivals(stream: DataFrame, log: InsertLog, checkpoint: str) -> DataStreamWriter:
    """First arrival of each key, kept in a log for good; of copies in one batch the earliest stays.

    A batch reads the stored buckets that may hold one of its keys, not the log.
    """
    return stream.writeStream.foreachBatch(log.insert).option("checkpointLocation", checkpoint)


def upserts(stream: DataFrame, log: ChangeLog, checkpoint: str) -> DataStreamWriter:
    """At-least-once input, exactly-once table: each batch is reduced to the newest version per
    key before it is logged."""

    def write(batch: DataFrame, batch_id: int) -> None:
        log.write(events.keep_latest(batch, log.keys, F.struct("ts")), batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def fan_out(stream: DataFrame, branches: dict[str, str], root: str,
            checkpoint: str) -> DataStreamWriter:
    """Several consumers of one source, read once: name -> SQL condition, each into its folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, condition in branches.items():
                batch.filter(condition).write.mode("overwrite").parquet(
                    f"{root}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


JOIN_DDL = (
    "pass_id string, plot_id string, pass_ts timestamp, ndvi double, readings array<struct<"
    "weather_id: string, weather_ts: timestamp, temperature_c: double>>"
)


def interval_updates(passes: DataFrame, readings: DataFrame, rows: str, log: ChangeLog,
                     checkpoint: str, hours: int = C.JOIN_LOOKBACK_HOURS) -> DataStreamWriter:
    """The left outer interval join in a log (keys: pass_id, schema: JOIN_DDL), for input in any
    order: nothing is dropped for being late.

    Both sides' rows are kept below `rows`, by day. A batch touches stretches of a plot's time as
    long as the look-back; passes of these and the next stretch are joined again, from rows of the
    days concerned, and logged with all their readings.
    """
    span = hours * 3600
    stretch = F.floor(F.unix_seconds("ts") / F.lit(span)).cast("bigint")
    both = events.union_all(
        passes.select(F.lit(True).alias("is_pass"), "event_uuid", "plot_id", "ts", F.col("ndvi").alias("x")),
        readings.select(F.lit(False).alias("is_pass"), "event_uuid", "plot_id", "ts",
                        F.col("temperature_c").alias("x")),
    ).withColumns({"stretch": stretch, "day": F.to_date("ts")})
    ddl = "is_pass boolean, event_uuid string, plot_id string, ts timestamp, x double, stretch bigint"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{rows}/batch_id={batch_id}")
        known = spark.read.schema(f"{ddl}, batch_id bigint, day date").option("basePath", rows).parquet(rows) \
            .filter(F.col("batch_id") <= batch_id)
        own = known.filter(F.col("batch_id") == batch_id)
        touched = own.select("plot_id", F.explode(F.array("stretch", F.col("stretch") + 1)).alias("stretch")) \
            .distinct()
        # a touched stretch looks back into the one before it
        wide = touched.select("plot_id", F.explode(F.array("stretch", F.col("stretch") - 1)).alias("stretch")) \
            .distinct().withColumn("day", F.explode(F.sequence(
                F.to_date(F.timestamp_seconds(F.col("stretch") * span)),
                F.to_date(F.timestamp_seconds((F.col("stretch") + 1) * span - 1)))))
        near = known.join(wide, ["plot_id", "stretch", "day"], "left_semi")
        left = near.filter("is_pass").join(touched, ["plot_id", "stretch"], "left_semi")
        right = near.filter("NOT is_pass").select(
            F.col("plot_id").alias("w_plot"), F.col("event_uuid").alias("weather_id"),
            F.col("ts").alias("weather_ts"), F.col("x").alias("temperature_c"),
            F.explode(F.array("stretch", F.col("stretch") + 1)).alias("w_stretch"))
        meets = (F.col("plot_id") == F.col("w_plot")) & (F.col("stretch") == F.col("w_stretch")) \
            & (F.col("weather_ts") <= F.col("ts")) \
            & (F.col("weather_ts") >= F.col("ts") - F.expr(f"interval {hours} hours"))
        # passes without a plot match nothing and are kept
        unplaced = own.filter("is_pass AND plot_id IS NULL")
        joined = left.unionByName(unplaced, allowMissingColumns=True).join(right, meets, "left")
        log.write(joined.groupBy(
            F.col("event_uuid").alias("pass_id"), "plot_id", F.col("ts").alias("pass_ts"),
            F.col("x").alias("ndvi")).agg(F.collect_list(F.when(
                F.col("weather_id").isNotNull(), F.struct("weather_id", "weather_ts", "temperature_c")))
                .alias("readings")), batch_id)

    return both.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def current_pairs(log: ChangeLog) -> DataFrame:
    """A row per pass and reading; a pass without a reading keeps one row."""
    return log.current().select(
        "pass_id", "plot_id", "pass_ts", "ndvi", F.explode_outer("readings").alias("r")).select(
            "pass_id", "plot_id", "pass_ts", "ndvi", "r.*")


def late_split(stream: DataFrame, newest: ChangeLog, path: str, checkpoint: str,
               delay: str = C.WATERMARK_DELAY) -> DataStreamWriter:
    """Tag rows that are older than their plot's newest event of earlier batches by more than the
    delay, and write late and punctual rows into separate folders.

    The engine's own watermark drops late rows without a trace; here they are kept. What is
    remembered is one time per plot, logged per batch (a log whose version is `newest`), so no
    state is held in Python and a batch that is run again sees the same times.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            known = newest.current(before=batch_id)
            bound = F.col("newest") - F.expr(f"interval {delay}")
            tagged = batch.join(known, "plot_id", "left").withColumn(
                "late", F.coalesce(F.col("ts") < bound, F.lit(False))).drop("newest")
            tagged.write.mode("overwrite").partitionBy("late").parquet(
                f"{path}/batch_id={batch_id}")
            newest.write(batch.groupBy("plot_id").agg(F.max("ts").alias("newest")), batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def last_readings(stream: DataFrame, readings: list[str]) -> DataFrame:
    """Last known reading of each kind per plot, across windows.

    A streaming aggregate: its state is one row per plot, and a batch is reduced per task before
    it reaches the state.
    """
    newest = F.struct("ts", "event_uuid")
    return stream.filter(F.col("plot_id").isNotNull()).groupBy("plot_id").agg(*[
        F.max_by(F.col(r), F.when(F.col(r).isNotNull(), newest)).alias(f"last_{r}")
        for r in readings
    ], F.max("ts").alias("last_ts"))


def ingest(records: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Batch ingestion: decode, judge, route. Accepted and quarantined rows go into folders of
    their own in one pass, below their batch's."""
    flat = events.flatten(events.parse(records), "record_id", "bad_record", "value")
    judged = quality.with_reasons(flat)
    undecodable = F.col("bad_record").isNotNull()
    routed = judged.withColumn(
        "reasons", F.when(undecodable, F.array(F.lit("undecodable"))).otherwise(F.col("reasons"))
    ).withColumns({
        "outcome": F.when(F.size("reasons") == 0, "accepted").otherwise("quarantined"),
        "topic": text.topic_of(F.col("event_type")),
    })
    out = routed.select(
        "outcome", "topic", "record_id", F.coalesce("plot_id", "crop").alias("key"), "value",
        "reasons")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("outcome", "topic").parquet(
            f"{path}/batch_id={batch_id}")

    return out.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def run_counters(spark: SparkSession, path: str, after: int = -1) -> dict[str, int]:
    """Counters of an ingestion run, from what it wrote: the batches after the last one before it."""
    # a batch without rows leaves no partition folders, but counts nothing either
    row = spark.read.option("basePath", path).parquet(f"{path}/*/*/*").filter(
        F.col("batch_id") > after).agg(
            F.count(F.lit(1)).alias("fetched"),
            F.count_if(F.col("outcome") == "accepted").alias("messages_sent")).first()
    return row.asDict()
