"""Readers and writers. Each external system sits behind one function; its connector jar is the
deployment's business."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from furrow import contracts as C
from furrow.operators.events import once
from furrow.sources import json_array

ROWS_PER_FILE = 5_000_000


def read_json_array(spark: SparkSession, path: str, split_bytes: int = json_array.SPLIT_BYTES) -> DataFrame:
    """Events from files that each hold one JSON array, large ones in splits."""
    texts = json_array.elements(spark, path, split_bytes)
    return once(texts, "event", F.from_json("value", C.EVENT_DDL)).select("event.*")


def write_json_array(events: DataFrame, path: str) -> None:
    """Indented array files, one per partition."""
    json_array.write(events.select(
        F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")), path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(C.EVENT_DDL).json(path)


def write_json_lines(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").json(path)


def read_topics(spark: SparkSession, servers: str, topics: list[str], **options) -> DataFrame:
    """Stream of topic records from a broker, with its rate bounded per micro-batch."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .option("maxOffsetsPerTrigger", options.pop("max_offsets", 5_000_000))
        .options(**options).load()
        .select("topic", F.col("key").cast("string").alias("key"),
                F.col("value").cast("string").alias("value"),
                F.col("timestamp").alias("received"))
    )


def write_topics(records: DataFrame, servers: str, checkpoint: str) -> DataStreamWriter:
    """Stream sink to a broker; each row names its topic."""
    return (
        records.select("topic", "key", "value").writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
        .option("checkpointLocation", checkpoint)
    )


def write_topic_files(records: DataFrame, path: str) -> None:
    """The same routing into one folder per topic."""
    records.write.mode("overwrite").partitionBy("topic").parquet(path)


def write_lake(events: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Curated table in folders by event type and date.

    Rows are laid out in ranges of (type, date, id): each folder gets few files, and a type or a
    day with most of the rows is written by many tasks, not one.
    """
    dated = events.withColumn("event_date", F.to_date("ts"))
    (
        dated.repartitionByRange("event_type", "event_date", "event_uuid")
        .write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
        .partitionBy("event_type", "event_date").parquet(path)
    )


def read_lake(spark: SparkSession, path: str, *types: str) -> DataFrame:
    """The curated table; a choice of types reads only their folders."""
    lake = spark.read.parquet(path)
    return lake.filter(F.col("event_type").isin(list(types))) if types else lake


def write_jdbc(df: DataFrame, url: str, table: str, **properties: str) -> None:
    """Snapshot into a relational table; truncates and refills it, keeping its definition."""
    df.write.mode("overwrite").option("truncate", True).jdbc(url, table, properties=properties)


def read_protobuf(records: DataFrame, message: str, descriptor: bytes) -> DataFrame:
    """Decode binary payloads; needs the protobuf module of Spark on the class path."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return records.withColumn(
        "event", from_protobuf("value", message, binaryDescriptorSet=descriptor))


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Add created alerts or reports to the served table."""
    alerts.write.mode("append").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
